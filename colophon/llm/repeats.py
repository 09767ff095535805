"""Repeated windows of tokens across a corpus: what substring dedup and suffix-array dedup share.

A window is a run of ``window`` tokens of one document; it is a repeat if its tokens also start earlier, in a document that
comes before or earlier in the same one. Documents come in the order of doc_id (null last), then of the digest of the text.
A token is repeated if a repeated window covers it. The corpus is worked on in blocks of documents:

1. *Blocks.* Documents go to blocks by the digest of their text, so all that may be the first with a text meet. Rows that
   come after another of their task are copies: their result is known at once, and they go to any block, without a text.
2. *Anchors.* Each window selects the gram of least hash in it (the last such one): windows with equal tokens select the
   same gram at the same place. Each block sends the hashes of its anchors, packed, to buckets; a bucket counts them and
   answers each block with those found twice or more in the corpus.
3. *Spans.* Around each repeated anchor, a block sends out the stretch of text that the windows of that anchor cover. An
   anchor found often is split over salts by document and place.
4. *Resolution.* Spans with the same anchor (and salt) meet; ``Kind.classes`` groups their windows by content, and all but
   the first of a group are repeats. Where an anchor has several salts, the first of each salt go on, by a digest of their
   content, to be compared once more.
5. *Removal.* The repeats go back to the blocks, which mark the tokens they cover.

All steps are one plan. The exchange that forms the blocks is read three times; every other exchange carries hashes and
spans of what is repeated. No step has work that grows with the square of a group.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import give_back, shuffle_partitions, small_batches, utf8

PLACE_BITS = 28
LAST_ID = (1 << 63) - 1
#: Occurrences of an anchor that go to one salt, on average.
SALT_ROWS = 512
CHUNK = 1 << 18
#: Words of more bytes are told apart by a cryptographic hash.
LONG_WORD = 64
#: Blocks for each partition: a block is in a worker's memory as a whole.
BLOCKS = 3

SPAN = np.dtype([("h", "<u8"), ("tag", "<u8"), ("id", "<i8"), ("salts", "<u4"), ("block", "<u4"), ("lo", "<u4"), ("off", "<u4"), ("n", "<u4"), ("size", "<u4")])
REPEAT = np.dtype([("tag", "<u8"), ("lo", "<u4"), ("n", "<u4")])
OPEN = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("tag", "<u8"), ("id", "<i8"), ("block", "<u4"), ("lo", "<u4")])

# Random odd multipliers and byte values of the polynomial hashes.
_RNG = np.random.default_rng(20240229)
BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = tuple(int(x) * 8 + 5 for x in _RNG.integers(1 << 40, 1 << 60, 3))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b & ((1 << 64) - 1), np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _POWERS[base] = made[0], made[1]
    return _POWERS[base][0][:n], _POWERS[base][1][:n]


class Rolling:
    """Hashes of runs of values, from prefix sums."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self.down = powers(base, n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


@dataclass
class Tokens:
    """The tokens of some texts, back to back: their values, the tokens of each text, and the bytes from and to which each goes."""

    values: np.ndarray
    counts: np.ndarray
    start: np.ndarray | None = None  # None: a token is a byte
    end: np.ndarray | None = None
    data: bytes = b""

    def slice(self, a: int, b: int) -> bytes:
        """The bytes of the tokens from a to b."""
        return self.data[a:b] if self.start is None else self.data[self.start[a] : self.end[b - 1]]


def byte_tokens(texts: list[bytes]) -> Tokens:
    data = b"".join(texts)
    return Tokens(BYTES[np.frombuffer(data, np.uint8)], np.array([len(t) for t in texts], np.int64), data=data)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_tokens(texts: list[bytes]) -> Tokens:
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate(([True], _SPACE[raw]))
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    hashes = mix(Rolling(BYTES[raw], BASES[0]).of(start, end - start) + (end - start).astype(np.uint64))
    # such polynomials are the same for certain pairs of long strings over two letters
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, bounds)
    return Tokens(hashes, np.diff(upto, prepend=0), start, end, data)


@dataclass(frozen=True)
class Kind:
    window: int
    gram: int
    tokens: Callable[[list[bytes]], Tokens]
    #: (spans, their texts, kind) -> for each window of each span, in order, the number of its class
    classes: Callable[[np.ndarray, list[bytes], Kind], np.ndarray]


def anchored(kind: Kind, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lo, n, off, h): runs of n windows from token lo on that select the same anchor, which stands off tokens after lo."""
    total, width = len(t.values), kind.window - kind.gram + 1
    none = np.zeros(0, np.int64)
    if total >= 1 << PLACE_BITS:
        raise ValueError(f"a text of {total} tokens: {1 << PLACE_BITS} are too many")
    if total < kind.window:
        return none, none, none, none.astype(np.uint64)
    grams = mix(Rolling(t.values, BASES[1]).of(np.arange(total - kind.gram + 1), kind.gram))
    place = np.uint64((1 << PLACE_BITS) - 1)
    key = (grams & ~place) | (place - np.arange(len(grams), dtype=np.uint64))
    anchor = (place - (sliding_least(key, width) & place)).astype(np.int64)
    ends = np.repeat(np.cumsum(t.counts), t.counts)[: len(anchor)]
    good = np.flatnonzero(np.arange(len(anchor)) + kind.window <= ends)
    if not len(good):
        return none, none, none, none.astype(np.uint64)
    at = anchor[good]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (good[1:] != good[:-1] + 1))))
    lo, p = good[new], at[new]
    # an anchor is the least of its window, so its hash is a small number; mixed again, it goes to any bucket
    return lo, np.diff(np.append(new, len(good))), p - lo, mix(grams[p])


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield a, b
            a, size = b, 0
        size += len(t)
    if texts:
        yield a, len(texts)


def digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


def to_blocks(docs: DataFrame, n_parts: int, kind: Kind, finish, out: StructType) -> DataFrame:
    """docs dealt to blocks, with __sig, __block, __copy and __done.

    A row that is certainly not the first with its text is a copy: its result (``out``, in __done) is known here, it loses
    its text and may go to any block. So a text reaches its block only from rows that may be the first.
    """
    names, n_blocks = docs.columns, BLOCKS * n_parts
    schema = StructType([*docs.schema.fields, StructField("__sig", BinaryType()), StructField("__block", IntegerType()), StructField("__copy", BooleanType()), StructField("__done", out)])
    done_type = pa.struct([(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, fields = names.index("text"), [f.name for f in out.fields]
        seen: dict[bytes, int] = {}  # by digest, the least id so far in this task
        for batch in parts:
            texts = batch.column(at).to_pylist()
            ids = [order_id(i) for i in batch.column(names.index("doc_id")).to_pylist()]
            raw = utf8(texts)
            sigs = [digest(t) for t in raw]
            copy = later_ones(sigs, ids, seen)
            results: dict[bytes, dict] = {}
            for t, s, c in zip(raw, sigs, copy):
                if c and s not in results:
                    tokens = kind.tokens([t])
                    results[s] = dict(zip(fields, finish(tokens, np.full(len(tokens.values), len(tokens.values) >= kind.window))))
            blocks = [(spread(i) if c else int.from_bytes(s[8:12], "little")) % n_blocks for s, i, c in zip(sigs, ids, copy)]
            cols = list(batch.columns)
            cols[at] = pa.array([None if c else t for t, c in zip(texts, copy)], pa.string())
            done = pa.array([results[s] if c else None for s, c in zip(sigs, copy)], done_type)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sigs, pa.binary()), pa.array(blocks, pa.int32()), pa.array(copy, pa.bool_()), done], [*names, "__sig", "__block", "__copy", "__done"])

    return docs.mapInArrow(run, schema).repartition(n_parts, "__block")


def order_id(doc_id: int | None) -> int:
    return LAST_ID if doc_id is None else doc_id


def later_ones(sigs: list[bytes], ids: list[int], seen: dict[bytes, int]) -> list[bool]:
    """Whether a row is certainly not the first with its digest: another row of the batch, or one that the task has seen,
    comes before it. Of rows with the same id the first met counts."""
    first: dict[bytes, int] = {}
    for i, s in enumerate(sigs):
        j = first.setdefault(s, i)
        if ids[i] < ids[j]:
            first[s] = i
    later = [first[s] != i or ids[i] >= seen.get(s, LAST_ID + 1) for i, s in enumerate(sigs)]
    for s, i in first.items():
        seen[s] = min(seen.get(s, LAST_ID), ids[i])
    return later


def spread(i: int) -> int:
    """A number for the block of a row that may go to any."""
    return (i * 0x9E3779B97F4A7C15 & LAST_ID) >> 20


def tag_of(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little")


def firsts(table: pa.Table | pa.RecordBatch) -> dict[bytes, int]:
    """Of a block's rows: by digest, the row of the first document with that text. Only whole texts count."""
    found: dict[bytes, int] = {}
    ids = table.column("doc_id").to_pylist()
    for i, (s, c) in enumerate(zip(table.column("__sig").to_pylist(), table.column("__copy").to_pylist())):
        if not c and (s not in found or order_id(ids[i]) < order_id(ids[found[s]])):
            found[s] = i
    return found


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def block_hashes(hashes: np.ndarray, block: int, n_buckets: int, kind: str = "<u8") -> pa.RecordBatch:
    """A row per bucket: the block's distinct hashes (or their lower half), those found once and the others with their counts."""
    h, count = np.unique(hashes, return_counts=True)
    cuts = np.searchsorted(bucket_of(h, n_buckets), np.arange(n_buckets + 1))
    narrow = lambda x: (x if kind == "<u8" else x & np.uint64((1 << 32) - 1)).astype(kind).tobytes()
    rows = []
    for b in np.flatnonzero(np.diff(cuts)):
        x, c = h[cuts[b] : cuts[b + 1]], count[cuts[b] : cuts[b + 1]]
        rows.append((int(b), block, narrow(x[c == 1]), narrow(x[c > 1]), c[c > 1].astype("<u4").tobytes()))
    cols = list(zip(*rows)) or [[]] * 5
    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["bucket", "block", "once", "many", "counts"])


HASHES = "bucket int, block int, once binary, many binary, counts binary"
ANSWERS = "block int, bucket int, hashes binary, counts binary"


def count_hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers each block with those of its hashes that were sent twice or more in all, and how often."""
    yield from _count(parts, "<u8")


def count_narrow_hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same for hashes of which 32 bits are sent: with the bucket, about 2**32 values for each bucket."""
    yield from _count(parts, "<u4")


def _count(parts: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    buckets: dict[int, list[dict]] = {}
    for batch in parts:
        for r in batch.to_pylist():
            buckets.setdefault(r.pop("bucket"), []).append(r)
    for bucket in list(buckets):  # one, as buckets are dealt
        yield from _count_bucket(bucket, buckets.pop(bucket), kind)
    give_back()


def _count_bucket(bucket: int, rows: list[dict], kind: str) -> Iterator[pa.RecordBatch]:
    own = [np.concatenate([np.frombuffer(r["once"], kind), np.frombuffer(r["many"], kind)]) for r in rows]
    counts = np.concatenate([np.concatenate([np.ones(len(r["once"]) // np.dtype(kind).itemsize, np.uint32), np.frombuffer(r["counts"], "<u4")]) for r in rows])
    every = np.concatenate(own)
    blocks = [r["block"] for r in rows]
    rows.clear()
    order = np.argsort(every)
    every, counts = every[order], counts[order]
    del order
    new = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    total = np.add.reduceat(counts, new, dtype=np.int64)
    known, total = every[new][total > 1], np.minimum(total[total > 1], (1 << 32) - 1).astype("<u4")
    del every, counts, new
    for block, x in zip(blocks, own):
        at = look_up(known, x)
        hit = at >= 0
        if hit.any():
            cols = [pa.array([block], pa.int32()), pa.array([bucket], pa.int32()), pa.array([x[hit].tobytes()], pa.binary()), pa.array([total[at[hit]].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "bucket", "hashes", "counts"])


def answers(table: pa.Table, kind: str = "<u8") -> tuple[np.ndarray, np.ndarray]:
    """The block's repeated hashes, sorted, and their counts. Narrow ones come with their bucket in the upper half."""
    wide = lambda x, b: np.frombuffer(x, kind).astype(np.uint64) | np.uint64(0 if kind == "<u8" else b << 32)
    h = np.concatenate([wide(x, b) for x, b in zip(table.column("hashes").to_pylist(), table.column("bucket").to_pylist())] or [np.zeros(0, np.uint64)])
    c = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()] or [np.zeros(0, np.uint32)])
    order = np.argsort(h)
    return h[order], c[order]


def look_up(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x in the sorted array known; -1 where it isn't there."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


def salt_of(spans: np.ndarray) -> np.ndarray:
    """The salt of each span, by its document and place: one document may hold an anchor very often, too."""
    return mix(spans["tag"] + spans["lo"] * np.uint64(0x9E3779B97F4A7C15)) % spans["salts"]


def window_hashes(kind: Kind, spans: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each window of each span."""
    t = kind.tokens(texts)
    base = np.cumsum(t.counts) - t.counts
    n = spans["n"].astype(np.int64)
    at = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return tuple(mix(Rolling(t.values, b).of(at, kind.window)) for b in BASES[1:])


def _blob(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _split(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, places) for each value."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else []
    return [(int(s[a]), order[a:b]) for a, b in zip(new, [*new[1:], len(s)])]


def _repeats(spans_of: np.ndarray, place: np.ndarray, spans: np.ndarray) -> list[tuple]:
    """Rows (block, repeats): the windows at ``place`` of the spans ``spans_of``, as runs, by block."""
    if not len(place):
        return []
    new = np.flatnonzero(np.concatenate(([True], (np.diff(spans_of) != 0) | (np.diff(place) != 1))))
    out = np.zeros(len(new), REPEAT)
    s = spans[spans_of[new]]
    out["tag"], out["lo"], out["n"] = s["tag"], s["lo"] + place[new], np.diff(np.append(new, len(place)))
    return [(b, out[i].tobytes()) for b, i in _split(s["block"])]


ROUTED = ["route", "block", "repeats", "open"]
ROUTED_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _resolver(kind: Kind, n_parts: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        metas, texts = [], []
        for batch in parts:
            for meta, text in zip(batch.column("meta").to_pylist(), batch.column("text").to_pylist()):
                m = np.frombuffer(meta, SPAN)
                metas.append(m)
                ends = np.cumsum(m["size"].astype(np.int64))
                texts.extend(text[a:b] for a, b in zip(ends - m["size"], ends))
        if not metas:
            return
        spans = np.concatenate(metas)
        # by anchor, in pieces of bounded size; an anchor's spans (of a salt) stay together
        order = np.lexsort((salt_of(spans), spans["h"]))
        spans = spans[order]
        texts = [texts[i] for i in order]
        salt = salt_of(spans)
        new = np.concatenate(([True], (spans["h"][1:] != spans["h"][:-1]) | (salt[1:] != salt[:-1])))
        bounds = np.append(np.flatnonzero(new), len(spans))
        size = np.cumsum(spans["size"].astype(np.int64))
        a = 0
        while a < len(spans):
            upto = np.searchsorted(size, (size[a - 1] if a else 0) + 4 * CHUNK)
            b = int(max(bounds[np.searchsorted(bounds, upto, "right") - 1], bounds[np.searchsorted(bounds, a, "right")]))
            yield from piece(spans[a:b], texts[a:b])
            a = b
        give_back()

    def piece(spans: np.ndarray, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        n = spans["n"].astype(np.int64)
        of = np.repeat(np.arange(len(spans)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        # the rank of a span's document; with the place of the window, a window's rank
        doc_order = np.lexsort((spans["tag"], spans["id"]))
        d = spans[doc_order]
        rank = np.empty(len(spans), np.int64)
        rank[doc_order] = np.cumsum(np.concatenate(([False], (d["id"][1:] != d["id"][:-1]) | (d["tag"][1:] != d["tag"][:-1]))))
        when = (rank[of] << 32) + spans["lo"][of] + place
        group = kind.classes(spans, texts, kind)
        # salts are different groups: their firsts are compared later
        salt = salt_of(spans)[of]
        order = np.lexsort((when, salt, group))
        g, s = group[order], salt[order]
        first = np.empty(len(of), bool)
        first[order] = np.concatenate(([True], (g[1:] != g[:-1]) | (s[1:] != s[:-1])))
        rows = [(b, b, r, None) for b, r in _repeats(of[~first], place[~first], spans)]
        split = np.flatnonzero(first & (spans["salts"][of] > 1))
        if len(split):
            w1, w2 = window_hashes(kind, spans, texts)
            out = np.zeros(len(split), OPEN)
            src = spans[of[split]]
            out["w1"], out["w2"], out["lo"] = w1[split], w2[split], src["lo"] + place[split]
            for f in ("tag", "id", "block"):
                out[f] = src[f]
            rows += [(t, None, None, out[i].tobytes()) for t, i in _split(bucket_of(out["w1"], n_parts))]
        yield _blob(rows, ROUTED, ROUTED_TYPES)

    return run


def _settle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes repeats on; of windows that several salts hold, all but the first are repeats too."""
    held = []
    for batch in parts:
        rows = [(b, r) for b, r in zip(batch.column("block").to_pylist(), batch.column("repeats").to_pylist()) if r is not None]
        if rows:
            yield _blob(rows, ["block", "repeats"], [pa.int32(), pa.binary()])
        held += [np.frombuffer(x, OPEN) for x in batch.column("open").to_pylist() if x is not None]
    if held:
        x = np.concatenate(held)
        x = x[np.lexsort((x["lo"], x["tag"], x["id"], x["w2"], x["w1"]))]
        again = np.concatenate(([False], (x["w1"][1:] == x["w1"][:-1]) & (x["w2"][1:] == x["w2"][:-1])))
        x = x[again]
        out = np.zeros(len(x), REPEAT)
        out["tag"], out["lo"], out["n"] = x["tag"], x["lo"], 1
        yield _blob([(b, out[i].tobytes()) for b, i in _split(x["block"])], ["block", "repeats"], [pa.int32(), pa.binary()])


def repeated_tokens(docs: DataFrame, kind: Kind, finish, out: StructType) -> DataFrame:
    """docs (all rows) with the columns ``out``; ``finish(text, kind, covered)`` gives them for one text.

    ``covered`` is a mask over the text's tokens, true where a repeated window covers one. Later copies of a text of
    ``window`` tokens or more are repeated as a whole.
    """
    n = shuffle_partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    blocks = to_blocks(docs, n, kind, finish, out)
    names = docs.columns

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        seen: set[bytes] = set()
        for batch in parts:
            sigs = batch.column("__sig").to_pylist()
            use = []
            for i, (s, c) in enumerate(zip(sigs, batch.column("__copy").to_pylist())):
                if not c and s not in seen:
                    seen.add(s)
                    use.append(i)
            column = batch.column("text")
            texts = utf8([column[i].as_py() for i in use])
            where = batch.column("__block").to_pylist()
            for a, b in _chunks(texts):
                t = kind.tokens(texts[a:b])
                lo, _, _, h = anchored(kind, t)
                if len(h):
                    doc = np.searchsorted(np.cumsum(t.counts), lo, "right")
                    for block, i in _split(np.array([where[use[a + d]] for d in range(b - a)])[doc]):
                        found.setdefault(block, []).append(h[i])
        for block in list(found):
            yield block_hashes(np.concatenate(found.pop(block)), block, n)
        give_back()

    known = blocks.mapInArrow(hashes, HASHES).repartitionById(n, F.col("bucket")).mapInArrow(count_hashes, ANSWERS)

    def spans(left: pa.Table, right: pa.Table) -> pa.Table:
        h_known, counts = answers(right)
        metas: dict[int, list] = {}
        if len(h_known) and left.num_rows:
            rows = sorted(firsts(left).items())
            column, ids = left.column("text"), left.column("doc_id")
            block = left.column("__block")[0].as_py()
            for a, b in _chunked(rows, column):
                texts = utf8([column[i].as_py() for _, i in rows[a:b]])
                t = kind.tokens(texts)
                lo, count, off, h = anchored(kind, t)
                at = look_up(h_known, h)
                hit = np.flatnonzero(at >= 0)
                if not len(hit):
                    continue
                ends = np.cumsum(t.counts)
                doc = np.searchsorted(ends, lo[hit], "right")
                m = np.zeros(len(hit), SPAN)
                m["h"], m["off"], m["n"], m["block"] = h[hit], off[hit], count[hit], block
                m["lo"] = lo[hit] - (ends - t.counts)[doc]
                m["tag"] = np.array([tag_of(s) for s, _ in rows[a:b]], np.uint64)[doc]
                m["id"] = np.array([order_id(ids[i].as_py()) for _, i in rows[a:b]], np.int64)[doc]
                m["salts"] = -(-counts[at[hit]].astype(np.int64) // SALT_ROWS)
                parts = [t.slice(x, x + y - 1 + kind.window) for x, y in zip(lo[hit].tolist(), count[hit].tolist())]
                m["size"] = [len(p) for p in parts]
                to = bucket_of(mix(m["h"] + salt_of(m)), n)
                for target, i in _split(to):
                    metas.setdefault(target, []).append((m[i].tobytes(), b"".join([parts[k] for k in i])))
        rows_out = [(t, b"".join(x for x, _ in v), b"".join(y for _, y in v)) for t, v in metas.items()]
        cols = list(zip(*rows_out)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()))], ["target", "meta", "text"])

    sent = blocks.groupBy("__block").cogroup(known.repartition(n, "block").groupBy("block")).applyInArrow(spans, "target int, meta binary, text binary")
    routed = sent.repartitionById(n, F.col("target")).mapInArrow(_resolver(kind, n), "route int, block int, repeats binary, open binary")
    settled = routed.repartition(n, "route").mapInArrow(_settle, "block int, repeats binary").repartition(n, "block")
    fields = [f.name for f in out.fields]

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.concatenate([np.frombuffer(x, REPEAT) for x in right.column("repeats").to_pylist()] or [np.zeros(0, REPEAT)])
        found = dict(_split_tags(found))
        first = firsts(left)
        texts = left.column("text")
        results: list = [d and tuple(d.values()) for d in left.column("__done").to_pylist()]
        later: dict[bytes, tuple] = {}
        sigs = left.column("__sig").to_pylist()
        many = {s for s, c in Counter(s for s, r in zip(sigs, results) if r is None).items() if c > 1}
        for sig, i in first.items():
            t = kind.tokens(utf8([texts[i].as_py()]))
            total = len(t.values)
            covered = np.zeros(total, bool)
            runs = found.get(tag_of(sig))
            if runs is not None:
                edge = np.zeros(total + 1, np.int32)
                np.add.at(edge, runs["lo"], 1)
                np.add.at(edge, np.minimum(runs["lo"].astype(np.int64) + runs["n"] - 1 + kind.window, total), -1)
                covered = np.cumsum(edge)[:-1] > 0
            results[i] = finish(t, covered)
            if sig in many:
                later[sig] = finish(t, np.full(total, total >= kind.window))
        for i, sig in enumerate(sigs):
            if results[i] is None:
                results[i] = later[sig]
        cols = list(zip(*results)) or [[]] * len(fields)
        arrow = [pa.array(c, _arrow(f.dataType)) for c, f in zip(cols, out.fields)]
        kept = [(k, left.column(k)) for k in names if k not in fields]
        return pa.table([*[c for _, c in kept], *arrow], [*[k for k, _ in kept], *fields])

    schema = StructType([*[f for f in docs.schema.fields if f.name not in fields], *out.fields])
    return blocks.groupBy("__block").cogroup(settled.groupBy("block")).applyInArrow(remove, schema)


def _arrow(kind):
    return pa.int64() if isinstance(kind, LongType) else pa.string()


def _split_tags(found: np.ndarray):
    found = found[np.argsort(found["tag"], kind="stable")]
    new = np.flatnonzero(np.concatenate(([True], found["tag"][1:] != found["tag"][:-1]))) if len(found) else []
    return [(int(found["tag"][a]), found[a:b]) for a, b in zip(new, [*new[1:], len(found)])]


def _chunked(rows: list, column) -> Iterator[tuple[int, int]]:
    a, size = 0, 0
    for b, (_, i) in enumerate(rows):
        if size > CHUNK:
            yield a, b
            a, size = b, 0
        v = column[i]
        size += v.as_buffer().size if v.is_valid else 0
    if rows:
        yield a, len(rows)
