"""A byte-level convolutional network in numpy that scores the quality of a text.

Each byte has an embedding. Learned filters of 8 bytes run with stride 4 over the whole text; they are max-pooled over
overlapping chunks of 512 bytes (step 256) that cover it, and the mean and the maximum over the chunks are combined into
one probability. Training runs on the driver over a bounded sample of labelled rows (``max_per_class`` rows of each label
and ``max_bytes`` of text, whole texts, in hash order); scoring covers all rows in Arrow batches of bounded memory.

Defined cases: null and empty texts are scored as a chunk of padding; a null doc_id isn't held out and never trains;
labels other than 0 and 1 are ignored, and of labels that contradict each other the smaller stands;
with fewer than one row of either label, all scores are the share of label 1 (0.5 without labels). Columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

WIDTH, STRIDE, HALF = 8, 4, 256  # bytes; a chunk is two halves
EMBED, FILTERS = 8, 16
FOLDS = 5


def held_out(doc_id):
    """Whether crc32 of the id as text is divisible by FOLDS: such rows never train."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


@dataclass
class Network:
    embed: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float


def _layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, each padded to whole halves with 4 bytes at least; the halves of each."""
    halves = np.array([(len(t) + WIDTH - STRIDE + HALF - 1) // HALF or 1 for t in texts], np.int64)
    data = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    at = 0
    for t, n in zip(texts, halves):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += int(n) * HALF
    return data, halves


def _last(halves: np.ndarray) -> np.ndarray:
    """The last position of each text: its window reaches into the next text, and sees padding there."""
    return np.cumsum(halves) * (HALF // STRIDE) - 1


def _windows(data: np.ndarray, halves: np.ndarray, embed: np.ndarray) -> np.ndarray:
    e = embed[data]
    n = (len(data) - WIDTH) // STRIDE
    view = np.lib.stride_tricks.as_strided(e, (n, WIDTH * EMBED), (STRIDE * EMBED * e.itemsize, e.itemsize))
    x = np.ascontiguousarray(view)
    x[_last(halves), STRIDE * EMBED :] = np.tile(embed[0], WIDTH - STRIDE)
    return x


def _pool(z: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(chunk maxima, first chunk of each text, halves' maxima, the half that gave each chunk's maximum)"""
    per = HALF // STRIDE
    half = z.reshape(-1, per, z.shape[1]).max(1)
    last = np.cumsum(halves) - 1
    nxt = np.arange(len(half)) + 1
    nxt[last] = last  # the last half of a text is a chunk by itself, unless it is the second of one
    chunk = np.maximum(half, half[nxt])
    which = np.where(half >= half[nxt], np.arange(len(half))[:, None], nxt[:, None])
    return chunk, np.cumsum(halves) - halves, half, which


def _features(data: np.ndarray, halves: np.ndarray, net: Network) -> np.ndarray:
    z = _windows(data, halves, net.embed) @ net.weight + net.bias
    np.maximum(z, 0, out=z)
    chunk, first, *_ = _pool(z, halves)
    return np.hstack([np.add.reduceat(chunk, first) / halves[:, None], np.maximum.reduceat(chunk, first)])


def predict(net: Network | float, texts: list[bytes], most: int = 1 << 19) -> np.ndarray:
    """Scores; batches of about ``most`` bytes bound the memory (longer texts are cut into pieces whose chunks overlap)."""
    if isinstance(net, float):
        return np.full(len(texts), net)
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end]) + HALF
            end += 1
        if end == at + 1 and len(texts[at]) > 4 * most:
            f = _long_features(texts[at], net, most)
        else:
            f = _features(*_layout(texts[at:end]), net)
        out[at:end] = 1 / (1 + np.exp(-np.clip(f @ net.out + net.out_bias, -30, 30)))
        at = end
    return out


def _long_features(text: bytes, net: Network, most: int) -> np.ndarray:
    """The features of one long text, from pieces that share a half: the same chunks, in bounded memory."""
    step = most // HALF * HALF
    total = 0
    sums, top = np.zeros(FILTERS), np.zeros(FILTERS)
    for at in range(0, len(text), step):
        last = at + step >= len(text)
        piece = text[at : at + step + (0 if last else HALF + WIDTH)]
        data, halves = _layout([piece])
        z = np.maximum(_windows(data, halves, net.embed) @ net.weight + net.bias, 0)
        chunk = _pool(z, halves)[0]
        if not last:
            chunk = chunk[: step // HALF]
        total += len(chunk)
        sums += chunk.sum(0)
        top = np.maximum(top, chunk.max(0))
    return np.hstack([sums / total, top])[None].astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 5, batch: int = 48, seed: int = 5) -> Network | float:
    """Adam on the logistic loss, both labels weighted alike."""
    y = np.asarray(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "weight": rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)),
        "bias": np.zeros(FILTERS), "out": rng.normal(0, 0.1, 2 * FILTERS), "out_bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    share = y.mean()
    weigh = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    order, step = np.arange(len(y)), 0
    epochs = max(epochs, min(24, -(-epochs * 1000 // len(y))))
    for epoch in range(epochs):
        rng.shuffle(order)
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            data, halves = _layout([texts[i] for i in ids])
            x = _windows(data, halves, p["embed"])
            z = np.maximum(x @ p["weight"] + p["bias"], 0)
            chunk, first, half, which = _pool(z, halves)
            mean, top = np.add.reduceat(chunk, first) / halves[:, None], np.maximum.reduceat(chunk, first)
            f = np.hstack([mean, top])
            score = 1 / (1 + np.exp(-np.clip(f @ p["out"] + p["out_bias"], -30, 30)))
            d = (score - y[ids]) * weigh[ids] / len(ids)
            g = {"out": f.T @ d, "out_bias": d.sum(keepdims=True)}
            df = d[:, None] * p["out"]
            doc = np.repeat(np.arange(len(ids)), halves)
            dc = df[doc, :FILTERS] / halves[doc, None] + df[doc, FILTERS:] * (chunk == top[doc]) / halves[doc, None]
            # back to the position that gave each chunk's maximum
            per = HALF // STRIDE
            inner = z.reshape(-1, per, FILTERS).argmax(1)
            pos = which * per + np.take_along_axis(inner, which, 0)
            dc = dc * (chunk > 0)
            ends = _last(halves)
            gw, spread, where = np.zeros_like(p["weight"]), [], []
            for k in range(FILTERS):
                used = np.flatnonzero(dc[:, k])
                gw[:, k] = dc[used, k] @ x[pos[used, k]]
                spread.append((dc[used, k][:, None] * p["weight"][:, k]).reshape(-1, EMBED))
                seen = data[(pos[used, k] * STRIDE)[:, None] + np.arange(WIDTH)]
                seen[np.isin(pos[used, k], ends), STRIDE:] = 0
                where.append(seen.ravel())
            spread, where = np.concatenate(spread), np.concatenate(where)
            ge = np.stack([np.bincount(where, spread[:, j], 256) for j in range(EMBED)], 1).astype(np.float32)
            g |= {"weight": gw, "embed": ge, "bias": dc.sum(0)}
            step += 1
            rate = 0.01 * (1 - 0.8 * epoch / epochs)
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Network(p["embed"], p["weight"], p["bias"], p["out"], float(p["out_bias"][0]))


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = 1000, max_bytes: int = 1 << 24, seed: int = 5) -> Network | float:
    """Trains on rows that aren't held out: at most ``max_per_class`` of each label, chosen by a hash of their ids."""
    pool = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pool = pool.groupBy("doc_id").agg(F.min("quality").alias("__y"))
    some = None
    for y in (0, 1):
        part = pool.filter(F.col("__y") == y).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_per_class)
        some = part if some is None else some.unionByName(part)
    # 2 * max_per_class ids at most: small enough to broadcast. Sizes come first; then the texts that fit, one of each id
    def least(ids: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").alias("__y"))

    sizes = least(some).select("doc_id", "__y", F.octet_length("text").alias("n")).toPandas()
    sizes = sizes.sort_values("doc_id").sample(frac=1, random_state=seed)
    sizes = sizes[sizes["n"].cumsum() <= max_bytes]
    ids = sizes["doc_id"].tolist()
    chosen = some.filter(F.col("doc_id").isin(ids))
    text = {r.doc_id: r.text for r in least(chosen).select("doc_id", "text").collect()}  # max_bytes at most
    return train(utf8([text[i] for i in ids]), sizes["__y"].to_numpy(), seed=seed)


def score_quality(docs: DataFrame, net: Network | float) -> DataFrame:
    """docs with a column ``score``: the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few thousand weights

    score = F.pandas_udf(_scorer(sent), "double")
    return docs.withColumn("score", score(F.col("text")))


def _scorer(sent):
    from collections.abc import Iterator

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(predict(sent.value, utf8(list(texts))), dtype="float64")

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return score
