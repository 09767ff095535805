"""Nearest neighbours by additive quantisation, with bounds that make the result exact.

Vectors are scaled to length one and encoded as a sum of one word from each of several full-dimensional codebooks, by beam
search. The codebooks are trained on a bounded sample (``max_train`` vectors in hash order): residual k-means first, then
rounds of beam encoding and least squares. A query makes a table of inner products with all words; the cosine with a code is
the sum of its entries over the norm of the code, which is stored. So is the angle between the code and its vector: no vector
is nearer to the query than the angle to its code less that one. The best ``rerank`` codes of each query are scored again
exactly, in double precision, on the original vectors, and then all whose bound reaches the best k found so far. Where codes
tell little, as with near copies by the thousand or directions without structure, that is many; but none is missed.

Equal vectors are indexed once. An index row keeps the k + 1 smallest ids of its vector, which is all that the k nearest of
any query can need, ties going to the smaller id. The index is dealt to blocks, the queries to bundles; each bundle meets
each block, and a meeting hands on the best k + 1 vectors of each query. Nothing is broadcast but the codebooks.

Defined cases: vectors that are null, zero, or hold a null or non-finite component take no part, neither as queries nor as
candidates, nor do those whose length isn't the most frequent one (ties: the greater) or whose id is null; rows equal in id
and vector count once, and a query leaves out every row with its own id; fewer candidates than k give fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dims) float32

    @property
    def flat(self) -> np.ndarray:
        return self.words.reshape(-1, self.words.shape[2])


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * (x @ c.T)).argmin(1)


def encode(x: np.ndarray, books: Codebooks, beam: int = 4, batch: int = 512) -> np.ndarray:
    """Codes (rows, books) uint8: for each vector the best sum that a beam search over the codebooks in turn finds."""
    m, k, _ = books.words.shape
    flat = books.flat
    cross = flat @ flat.T
    norm = np.einsum("ij,ij->i", flat, flat)
    out = np.empty((len(x), m), np.uint8)
    for at in range(0, len(x), batch):
        part = x[at : at + batch]
        n = len(part)
        gain = norm - 2 * (part @ flat.T)  # of each word alone
        codes, cost = np.zeros((n, 1, 0), np.int64), np.zeros((n, 1), np.float32)
        for b in range(m):
            words = slice(b * k, (b + 1) * k)
            new = cost[:, :, None] + gain[:, None, words]
            for j in range(b):
                new += 2 * cross[codes[:, :, j] + j * k, words]
            new = new.reshape(n, -1)
            width = min(beam, new.shape[1])
            best = np.argpartition(new, width - 1, axis=1)[:, :width]
            cost = np.take_along_axis(new, best, 1)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], 2)
        out[at : at + n] = codes[np.arange(n), cost.argmin(1)]
    return out


def train(x: np.ndarray, n_books: int = 16, n_words: int = 256, rounds: int = 2, beam: int = 4, seed: int = 3) -> Codebooks:
    rng = np.random.default_rng(seed)
    n_words = int(max(1, min(n_words, 256, len(x) // 2)))
    rest, books = x.copy(), []
    for _ in range(n_books):
        c = rest[rng.choice(len(rest), n_words, replace=False)].copy()
        for _ in range(6):
            a = _nearest(rest, c)
            count = np.bincount(a, minlength=n_words)
            order = np.argsort(a, kind="stable")
            full = np.flatnonzero(count)
            c[full] = np.add.reduceat(rest[order], (np.cumsum(count) - count)[full], axis=0) / count[full, None]
        books.append(c)
        rest = rest - c[_nearest(rest, c)]
    found = Codebooks(np.stack(books).astype(np.float32))
    for _ in range(rounds):
        codes = encode(x, found, beam)
        used = codes + np.arange(n_books) * n_words
        gram = np.zeros((n_books * n_words,) * 2, np.float32)
        for i in range(n_books):
            for j in range(n_books):
                np.add.at(gram, (used[:, i], used[:, j]), 1)
        right = np.zeros((len(gram), x.shape[1]), np.float32)
        for i in range(n_books):
            np.add.at(right, used[:, i], x)
        gram[np.diag_indices(len(gram))] += 0.1
        right += 0.1 * found.flat
        found = Codebooks(np.linalg.solve(gram, right).reshape(found.words.shape).astype(np.float32))
    return found


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vec): the rows that take part, each once; vec is the vector as an array of double."""
    v = F.col("embedding")
    ok = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(ok).select(F.col("vec_id").cast("long").alias("id"), v.cast("array<double>").alias("vec"))
    first = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("vec") == (first[0] if first else 0))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, ids): each vector once, with its ``keep`` smallest ids. Batches are thinned first, so a vector that many rows share stays small."""

    def thin(parts: Iterator[pa.RecordBatch], nested: bool) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list[int]] = {}

        def out():
            keys = list(found)
            ids = [sorted(set(found[k]))[:keep] for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], ["key", "ids"])

        for batch in parts:
            for k, i in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                held = found.setdefault(k, [])
                held.extend(i)
                if len(held) > 16 * keep:
                    found[k] = sorted(set(held))[:keep]
            if not nested and len(found) >= 20_000:
                yield out()
                found.clear()
        if found:
            yield out()

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def bare():
            for batch in parts:
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0  # no negative zeros
                flat = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat
                keys = [r.tobytes() for r in flat]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([[i] for i in batch.column("id").to_pylist()], pa.list_(pa.int64()))], ["key", "ids"])

        yield from thin(bare(), False)

    schema = "key binary, ids array<long>"
    part = rows.mapInArrow(keyed, schema).repartition("key")
    return part.mapInArrow(lambda parts: thin(parts, True), schema)


def _matrix(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<f8").reshape(len(keys), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _facts(x: np.ndarray, codes: np.ndarray, books: Codebooks) -> np.ndarray:
    """(rows, 3) float32: the norm of each code, its cosine with its vector (unit, double), and by how much single precision may err in cosines with it."""
    words = books.words.astype(np.float64)
    y = sum(words[j][codes[:, j]] for j in range(codes.shape[1]))
    norm = np.sqrt((y * y).sum(1))
    long = np.sqrt((words * words).sum(2))
    total = sum(long[j][codes[:, j]] for j in range(codes.shape[1]))
    flat = norm <= 1e-6 * total  # a sum that all but vanishes has no direction: nothing is known
    safe = np.where(flat, 1, norm)
    return np.stack([safe, np.where(flat, 0, (x * y).sum(1) / safe), np.where(flat, 4, 1e-6 + 2e-6 * total / safe)], 1).astype(np.float32)


def _best(keys: np.ndarray, ids: np.ndarray, codes: np.ndarray, facts: np.ndarray, queries: np.ndarray, books: Codebooks, most: int, rerank: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places and the cosines of the ``most`` nearest vectors, ties going to the smaller of ``ids``."""
    x, q = _unit(keys), _unit(queries)
    at = codes.astype(np.int64) + np.arange(codes.shape[1]) * books.words.shape[1]
    norm, cosine, slack = np.ascontiguousarray(facts.T)
    cosine = cosine - slack
    sine = np.sqrt(np.maximum(1 - cosine.astype(np.float64) ** 2, 0)).astype(np.float32)
    top, most = min(rerank, len(x)), min(most, len(x))
    squares = None
    out = []
    for one in range(len(q)):
        if one % 256 == 0:
            tables = (q[one : one + 256] @ books.flat.T.astype(np.float64)).astype(np.float32)
        t = tables[one % 256]
        s = t[at[:, 0]]
        for j in range(1, at.shape[1]):
            s += t[at[:, j]]
        s /= norm
        near = np.argpartition(-s, top - 1)[:top]
        found = x[near] @ q[one]
        if top < len(x) and top >= most:
            s += slack
            bound = np.where(s >= cosine, 1, s * cosine + np.sqrt(np.maximum(1 - s * s, 0)) * sine)
            near = np.flatnonzero(bound >= np.partition(found, top - most)[top - most] - 1e-5)
            found = x[near] @ q[one] if 4 * len(near) < len(x) else (x @ q[one])[near]
        elif top < len(x):
            near, found = np.arange(len(x)), x @ q[one]
        near = near[found >= np.partition(found, len(found) - most)[len(found) - most] - 1e-12]
        if squares is None:
            raw, squares = _scaled(keys), np.sqrt((_scaled(keys) ** 2).sum(1))
            asked = _scaled(queries)
        exact = (raw[near] * asked[one]).sum(1) / (squares[near] * np.sqrt((asked[one] ** 2).sum()))
        order = np.lexsort((ids[near], -exact))[:most]
        out.append((near[order], exact[order]))
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 256, n_books: int = 16, max_train: int = 8192, block: int = 1 << 24) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id ``every`` divides, its k nearest other rows by cosine.

    ``block``: bytes of the vectors of a block, and of a bundle of queries.
    """
    rows = usable(vectors)
    index = cut(_distinct(rows, k + 1).select(F.sha2("key", 256).alias("v"), "key", "ids"))
    spark = index.sparkSession
    last = index.select("v").orderBy("v").limit(max_train).agg(F.max("v")).first()[0]
    sample = index.select("v", "key").filter(F.col("v") <= F.lit(last)).orderBy("v").collect()  # max_train rows at most
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    books = spark.sparkContext.broadcast(train(_unit(_matrix([r.key for r in sample])).astype(np.float32), n_books))

    def coded(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for a in range(0, batch.num_rows, 2048):
                piece = batch.slice(a, 2048)
                x = _unit(_matrix(piece.column("key").to_pylist()))
                codes = encode(x.astype(np.float32), books.value)
                facts = _facts(x, codes, books.value)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([f.tobytes() for f in facts], pa.binary())], [*piece.schema.names, "code", "facts"])

    asked = rows.filter(F.col("id") % every == 0)
    # each query vector once, found by its place in the index
    queries = cut(index.select("v", "key").join(_keys(asked).select("v").distinct(), "v", "left_semi"))
    n_codes, n_queries, most = index.count(), queries.count(), max(1, block // len(sample[0].key))
    # small tables make smaller blocks, for parallel work; queries travel to blocks, as they are fewer
    blocks = max(1, -(-n_codes // min(most, max(4096, -(-n_codes // shuffle_partitions(spark))))))
    bundles = max(1, -(-n_queries // most))
    deal = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = index.mapInArrow(coded, "v string, key binary, ids array<long>, code binary, facts binary")
    codes = codes.select("key", "ids", "code", "facts", deal(blocks).alias("b")).withColumn("u", each(bundles)).repartition(blocks * bundles, "b", "u")
    met = queries.select(F.col("v").alias("q"), "key", deal(bundles).alias("u")).withColumn("b", each(blocks)).repartition(blocks * bundles, "b", "u")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        lists, qs, found = left.column("ids").combine_chunks(), [], []
        if left.num_rows and right.num_rows:
            keys, asked = (_matrix(t.column("key").to_pylist()) for t in (left, right))
            codes = np.frombuffer(b"".join(left.column("code").to_pylist()), np.uint8).reshape(left.num_rows, -1)
            facts = np.frombuffer(b"".join(left.column("facts").to_pylist()), "<f4").reshape(left.num_rows, -1)
            found = _best(keys, np.array([i[0].as_py() for i in lists]), codes, facts, asked, books.value, k + 1, rerank)
            qs = [name for name, (at, _) in zip(right.column("q").to_pylist(), found) for _ in at]
        at = np.concatenate([a for a, _ in found] or [np.zeros(0, np.int64)])
        scores = np.concatenate([s for _, s in found] or [np.zeros(0)])
        return pa.table([pa.array(qs, pa.string()), pa.array(scores, pa.float64()), lists.take(pa.array(at))], ["q", "score", "ids"])

    scored = codes.groupBy("b", "u").cogroup(met.groupBy("b", "u")).applyInArrow(score, "q string, score double, ids array<long>")
    return _finish(scored, rows, every, k)


def _keys(rows: DataFrame) -> DataFrame:
    """(id, v): each row's id and the name of its vector in the index."""

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in parts:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            names = [hashlib.sha256(r.tobytes()).hexdigest() for r in (flat.reshape(batch.num_rows, -1) if batch.num_rows else flat)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string())], ["id", "v"])

    return rows.mapInArrow(named, "id long, v string")


def _finish(scored: DataFrame, rows: DataFrame, every: int, k: int) -> DataFrame:
    """The k + 1 best ids of each query vector, of (q, score, ids); then each query without its own id."""
    each = scored.select("q", "score", F.explode("ids").alias("vec_id"))
    best = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))  # k + 1 at most
    asked = _keys(rows.filter(F.col("id") % every == 0)).distinct()
    own = asked.join(lists, asked.v == lists.q).select("id", F.slice(F.filter("found", lambda x: x.vec_id != F.col("id")), 1, k).alias("found"))
    out = own.select(F.col("id").alias("query_id"), F.posexplode("found").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
