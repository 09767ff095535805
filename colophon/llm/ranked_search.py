"""Ranked lexical search with inverted treaps.

``index_rows`` makes an index of all documents in one pass: a task deals its documents to shards, numbers each shard's
documents in the order of doc_id, and gives for each term of a shard the places of the documents that hold it, and how
often. It holds no number of the whole table, so the index of new documents can be put beside an old one. ``search`` takes
the terms of all items at once: it gives them their weights from the index's document frequencies, fetches their postings,
and in each shard links every term's postings to a treap: by place as the search order, by impact as the heap order. An
item's treaps are walked together. A part of the walk is a range of places with the node of greatest impact of each term in
it. The summed weighted maxima bound every score there: if they can't enter the item's best k, the range and all subtrees
below are dropped; else the document of the strongest node is scored exactly and splits the range. The walks of all items
advance together, level by level, in numpy. The best k of all shards meet in a window.

Score: the sum over an item's distinct terms of ``w * ((10^9 tf) div (1000 tf + 8 m))``, where m = 10 + (90 n N) div L, n
counts the document's terms, L all terms, N the documents with a term, and w = floor(1000 ln((2 N + 2) / (2 df + 1))).

At scale: documents aren't shuffled; a common term has a row per shard, never one for all. Postings of query terms alone
are shuffled, once, by shard. The terms of the items are broadcast only if their measured size is below ``BROADCAST``;
beyond that they are joined on the term and a salt from the shard, so that a common term is spread. Items are dealt to
blocks, so that a task sees so many items at a time; its walk holds at most ``FRONT`` nodes before it goes deep first.

Defined cases. A null or empty text has no terms and its document can't be found; the same for items, which then have no
rows; a row with a null item_id is no item. A null doc_id comes after all others, also among equal scores. Repeated
documents are ranked each, repeated items (by item_id) are one item with the terms of all its rows. Empty tables give an
empty result. Columns other than doc_id, text and item_id are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir, shuffle_partitions, utf8

#: A shard is full at so many documents, or postings.
SHARD_DOCS, SHARD_POSTINGS = 8192, 1 << 21
#: Items in a block; nodes that a walk holds at once; bytes of query terms that may be broadcast.
BLOCK_ITEMS, FRONT, BROADCAST = 256, 1 << 20, 64 << 20
SALTS = 16
SCALE = 1_000_000_000
#: What isn't part of a term; the letters that are lowered.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

#: The row of the empty term holds, by place, the doc_ids and lengths of a shard's documents; df is their number and total their terms.
INDEX = "shard long, term string, df long, total long, ids array<long>, lengths array<long>, places array<int>, counts array<int>"
_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("df", pa.int64()), ("total", pa.int64()), ("ids", _LONGS), ("lengths", _LONGS), ("places", _INTS), ("counts", _INTS)])


def terms_of(text: Column) -> Column:
    """The terms of a text, natively."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def split_terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Shard:
    """The postings of one shard while it is filled."""

    def __init__(self):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list = []
        self.sizes: list[int] = []
        self.lengths: list[int] = []
        self.term: list[int] = []
        self.tf: list[int] = []

    def add(self, doc_id, words: list[bytes]) -> None:
        counts: dict[bytes, int] = {}
        for w in words:
            counts[w] = counts.get(w, 0) + 1
        number = self.vocabulary
        self.term += [number.setdefault(w, len(number)) for w in counts]
        self.tf += counts.values()
        self.ids.append(doc_id)
        self.sizes.append(len(counts))
        self.lengths.append(len(words))


def _rows(shard: int, s: _Shard) -> Iterator[pa.RecordBatch]:
    """The index rows of a full shard: that of the empty term first, then one for each term."""
    none, ids = np.array([x is None for x in s.ids]), np.array([0 if x is None else x for x in s.ids], np.int64)
    order = np.lexsort((ids, none))
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    lengths = np.array(s.lengths, np.int64)
    term, tf = np.array(s.term, np.int64), np.array(s.tf, np.int32)
    where = np.repeat(place, np.array(s.sizes))
    by = np.lexsort((where, term))
    where, tf = where[by], tf[by]
    df = np.bincount(term, minlength=len(s.vocabulary))
    head = [[shard], [""], [len(order)], [int(lengths.sum())], [[s.ids[i] for i in order.tolist()]], [lengths[order].tolist()], [None], [None]]
    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(head, _ARROW)], schema=_ARROW)
    names = pa.array([w.decode("utf-8", "surrogatepass") for w in s.vocabulary], pa.string())
    ends = np.cumsum(df)
    total = np.add.reduceat(tf, ends - df, dtype=np.int64)
    at = 0
    while at < len(df):
        first = int(ends[at] - df[at])
        upto = max(at + 1, int(np.searchsorted(ends, first + (1 << 18), side="right")))
        offsets = pa.array(np.concatenate(([first], ends[at:upto])) - first, pa.int32())
        part, n = slice(first, int(ends[upto - 1])), upto - at
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[part])) for x in (where, tf)]
        numbers = [pa.array(x[at:upto].astype(np.int64)) for x in (df, total)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, shard)), names.slice(at, n), *numbers, pa.nulls(n, _LONGS), pa.nulls(n, _LONGS), *lists], schema=_ARROW)
        at = upto


def index_rows(docs: DataFrame, shard_docs: int | None = None) -> DataFrame:
    """The index of docs (doc_id, text) as rows of INDEX."""
    most = shard_docs or SHARD_DOCS

    def run(batches):
        from pyspark import TaskContext

        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in pieces(texts):
                for i, t in zip(ids[lo:hi], utf8(texts[lo:hi])):
                    words = split_terms(t)
                    if words:
                        shard.add(i, words)
                        if len(shard.ids) >= most or len(shard.term) >= SHARD_POSTINGS:
                            yield from _rows(number, shard)
                            number, shard = number + 1, _Shard()
        if shard.ids:
            yield from _rows(number, shard)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def totals(index: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms of all documents)"""
    heads = index.filter("term = ''")
    row = heads.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return row[0], row[1]


def _links(impact: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(root of each term, left and right child of each node): the treaps over first..last - 1 of every term.

    A node's parent is the weaker of the nearest stronger nodes on its two sides. Those are found by jumping: a node that
    isn't stronger passes on to the one it found itself, as all between are weaker still. Equal impacts are ordered by a
    mixed number, else a row of them would be a treap without branches.
    """
    n = len(impact)
    mixed = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)
    key = impact.astype(np.int64) << 22 | mixed.astype(np.int64)
    padded = np.concatenate((key, [np.iinfo(np.int64).max]))  # the last stands for: none
    term = np.repeat(np.arange(len(first)), last - first)

    def stronger(step: int) -> np.ndarray:
        edge = (first if step < 0 else last - 1)[term]
        place = np.arange(n)
        to = np.where(place == edge, n, place + step)
        live = np.flatnonzero(padded[to] <= key)
        while len(live):
            to[live] = to[to[live]]
            live = live[padded[to[live]] <= key[live]]
        return to

    before, after = stronger(-1), stronger(1)
    left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    own = np.arange(n)
    is_root = (before == n) & (after == n)
    under_before = ~is_root & ((after == n) | (before != n) & (padded[before] < padded[after]))
    under_after = ~is_root & ~under_before
    right[before[under_before]] = own[under_before]
    left[after[under_after]] = own[under_after]
    return np.flatnonzero(is_root), left[:n], right[:n]


class Treaps:
    """The treaps of one shard's terms, and the items that ask for them."""

    def __init__(self, places: list[np.ndarray], impacts: list[np.ndarray], weights: np.ndarray, askers: list[list[int]]):
        sizes = np.array([len(p) for p in places], np.int64)
        self.last = np.cumsum(sizes)
        self.first = self.last - sizes
        self.place = np.concatenate(places).astype(np.int64)
        impact = np.concatenate(impacts).astype(np.int64)
        self.root, self.left, self.right = _links(impact, self.first, self.last)
        self.term = np.repeat(np.arange(len(sizes)), sizes)
        self.gain = impact * weights[self.term]
        self.width = int(self.place.max()) + 1
        self.posting = self.term * self.width + self.place  # sorted
        n = np.array([len(a) for a in askers], np.int64)
        item, term = np.array([i for a in askers for i in a], np.int64), np.repeat(np.arange(len(sizes)), n)
        order = np.lexsort((term, item))
        self.items, self.starts = np.unique(item[order], return_index=True)
        self.asked = term[order]

    def settle(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The strongest node with lo <= place < hi at or below each node; -1: none."""
        node = node.copy()
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = self.place[node[live]]
            low, high = at < lo[live], at >= hi[live]
            live, low = live[low | high], low[low | high]
            u = node[live]
            node[live] = np.where(low, self.right[u], self.left[u])
            live = live[node[live] >= 0]
        return node

    def search(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(item, place, score) of the best k of each item, and the number of documents scored."""
        best = _Best(len(self.items), k)
        ends = np.append(self.starts[1:], len(self.asked))
        sizes = ends - self.starts
        n = len(self.items)
        stack = [(np.arange(n), np.zeros(n, np.int64), np.full(n, self.width, np.int64), sizes, self.root[self.asked])]
        scored = 0
        while stack:
            item, lo, hi, sizes, node = stack.pop()
            # ranges whose summed maxima can't enter the best k go
            of = np.repeat(np.arange(len(item)), sizes)
            bound = np.add.reduceat(self.gain[node], np.cumsum(sizes) - sizes)
            ok = best.may_enter(item, bound, lo)
            item, lo, hi, sizes, node, of = item[ok], lo[ok], hi[ok], sizes[ok], node[ok[of]], of[ok[of]]
            if not len(item):
                continue
            if len(node) > FRONT and len(item) > 1:
                half = max(1, int(np.searchsorted(np.cumsum(sizes), len(node) // 2)))
                cut = int(sizes[:half].sum())
                stack.append((item[half:], lo[half:], hi[half:], sizes[half:], node[cut:]))
                stack.append((item[:half], lo[:half], hi[:half], sizes[:half], node[:cut]))
                continue
            of = np.repeat(np.arange(len(item)), sizes)
            start = np.cumsum(sizes) - sizes
            # the document of the strongest node of each range is scored over all of the item's terms there
            gain = self.gain[node]
            top = np.maximum.reduceat(gain, start)
            hit = np.flatnonzero(gain == top[of])
            doc = self.place[node[hit[np.searchsorted(of[hit], np.arange(len(item)))]]]
            want = self.term[node] * self.width + doc[of]
            at = np.minimum(np.searchsorted(self.posting, want), len(self.posting) - 1)
            score = np.add.reduceat(np.where(self.posting[at] == want, self.gain[at], 0), start)
            best.add(item, doc, score)
            scored += len(item)
            # and splits it
            halves = []
            for a, b in ((lo, doc), (doc + 1, hi)):
                below = self.settle(np.where((a < b)[of], node, -1), a[of], b[of])
                there = below >= 0
                m = np.bincount(of[there], minlength=len(item))
                some = m > 0
                halves.append((item[some], a[some], b[some], m[some], below[there]))
            stack.append(tuple(np.concatenate(x) for x in zip(*halves)))
        return (*best.rows(self.items), scored)


class _Best:
    """The best k of each item so far: by score, then by place."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.score = np.full((items, k), -1, np.int64)
        self.place = np.full((items, k), np.iinfo(np.int64).max, np.int64)

    def may_enter(self, item: np.ndarray, bound: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Whether a document at lo or later with at most this score could be among the best."""
        worst, place = self.score[item, -1], self.place[item, -1]
        return (bound > 0) & ((bound > worst) | (bound == worst) & (lo < place))

    def add(self, item: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        enters = (score > self.score[item, -1]) | (score == self.score[item, -1]) & (place < self.place[item, -1])
        enters &= score > 0
        item, place, score = item[enters], place[enters], score[enters]
        if not len(item):
            return
        some = np.unique(item)
        all_item = np.concatenate((np.repeat(some, self.k), item))
        all_place = np.concatenate((self.place[some].ravel(), place))
        all_score = np.concatenate((self.score[some].ravel(), score))
        order = np.lexsort((all_place, -all_score, all_item))
        all_item = all_item[order]
        first = np.searchsorted(all_item, some)
        rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[rank < self.k]
        self.place[some] = all_place[kept].reshape(-1, self.k)
        self.score[some] = all_score[kept].reshape(-1, self.k)

    def rows(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = self.score > 0
        return np.broadcast_to(items[:, None], found.shape)[found], self.place[found], self.score[found]


FOUND = "item_id long, doc_id long, score long"


def _walk(k: int, docs: int, terms: int):
    """The best k documents of one shard for the items of one block."""

    def run(group: pa.Table) -> pa.Table:
        names = group["term"].to_pylist()
        head = names.index("")
        ids, lengths = (group[c].slice(head, 1).combine_chunks().flatten() for c in ("ids", "lengths"))
        m = 10 + 90 * lengths.to_numpy().astype(np.int64) * docs // terms
        rows = group.filter(pa.array([t != "" for t in names]))
        items: dict = {}
        item = place = score = np.zeros(0, np.int64)
        if rows.num_rows:
            places, counts = ([np.asarray(x.values) for x in rows[c]] for c in ("places", "counts"))
            impacts = [SCALE * (tf := n.astype(np.int64)) // (1000 * tf + 8 * m[p]) for p, n in zip(places, counts)]
            askers = [[items.setdefault(i, len(items)) for i in x] for x in rows["items"].to_pylist()]
            item, place, score, _ = Treaps(places, impacts, np.array(rows["w"].to_pylist(), np.int64), askers).search(k)
        asked = pa.array(list(items), pa.int64())
        return pa.table({"item_id": asked.take(pa.array(item, pa.int64())), "doc_id": ids.take(pa.array(place, pa.int64())), "score": pa.array(score, pa.int64())})

    return run


def search(index: DataFrame, items: DataFrame, k: int = 10, most_broadcast: int | None = None) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item (item_id, text) in an index that is written."""
    n_docs, n_terms = totals(index)
    asked = items.filter("item_id IS NOT NULL").select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(_blocks(items))).cast("int"))
    size = asked.agg(F.coalesce(F.sum(F.octet_length("term") + 48), F.lit(0))).first()[0]
    small = size <= (BROADCAST if most_broadcast is None else most_broadcast)
    words = asked.select("term").distinct()
    df = index.select("term", "df").join(F.broadcast(words), "term") if small else index
    df = df.groupBy("term").agg(F.sum("df").alias("df"))
    df = df if small else df.join(words, "term")
    w = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    # a term of weight 0 adds nothing
    weighed = asked.groupBy("block", "term").agg(F.collect_list("item_id").alias("items")).join(df.select("term", w.alias("w")), "term").filter("w > 0")
    heads = asked.select("block").distinct().select("block", F.lit("").alias("term"), F.array().cast("array<long>").alias("items"), F.lit(0).cast("long").alias("w"))
    wanted = weighed.select("block", "term", "items", "w").union(heads)
    if small:
        rows = index.join(F.broadcast(wanted), "term")
    else:
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = index.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(wanted, ["term", "salt"])
    # so many tasks, however few bytes: a walk is work
    rows = rows.repartition(shuffle_partitions(index.sparkSession), "shard", "block")
    found = rows.select("shard", "block", "term", "ids", "lengths", "places", "counts", "items", "w").groupBy("shard", "block").applyInArrow(_walk(k, n_docs, n_terms), FOUND)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _blocks(items: DataFrame) -> int:
    return max(1, math.ceil(items.count() / BLOCK_ITEMS))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """Indexes docs in a new folder of the shared one, and searches it for the items."""
    spark: SparkSession = docs.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    index_rows(docs).write.parquet(path)
    return search(spark.read.schema(INDEX).parquet(path), items, k)
