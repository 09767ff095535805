"""Near duplicates: a join on the Jaccard similarity of sets of word n-grams, by grouped prefixes, and its components.

Words are lower-cased (A to Z); a document's set holds its distinct n-grams (the whole sequence if it has fewer words),
by 64-bit hashes. Two documents link if 100 * intersection >= percent * union.

1. Documents with equal sets are one set, found in blocks by a digest of the set. A task lets only rows that may be the
   first of their set keep their text; the others are dealt by their ids. Blocks count in how many sets each n-gram occurs
   (32 bits of its hash and its bucket are sent).
2. n-grams are ordered by that count, rare ones first. A set of n has a prefix of n - ceil(percent n) + 1; two sets that
   link share an n-gram of their prefixes. n-grams found in one set alone fill the prefix without matching anything: sets
   whose prefix holds nothing else link with nothing. Few remain.
3. Sets with the same size and prefix are one group. Groups meet on the n-grams of their prefixes; each n-gram's groups
   are first compared with one of them, its hub: the one with the fewest n-grams of its own. Within a group all members
   are compared with its first. Sets that link are in one component.
4. What is left to compare, exactly: sets of different components that share an n-gram of their prefixes, and so its hub.
   Against the hub each set has c n-grams in common, others it lacks and others it has beside. From these numbers follows
   what two sets must have in common *of those differences*; so they are grouped once more, by differences and numbers,
   pairs of groups are filtered by the bounds, and only those that pass are expanded to members and verified
   (``_still_open``). Every pair that could still join two components is verified, so the components are those of all
   links, though not all links of a component are made.

Defined cases: texts without words and null texts have the empty set and link with nothing, not even each other; a null
doc_id comes after all others, and a component of such rows alone has a null id; repeated rows are in one component;
an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import cut, give_back, release, shuffle_partitions, small_batches, utf8
from .components import components
from .repeats import ANSWERS, BASES, BLOCKS, HASHES, Rolling, _chunks, answers, block_hashes, bucket_of, count_narrow_hashes, digest, later_ones, look_up, mix, order_id, spread, word_tokens

LOWER = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in _chunks(texts):
        t = word_tokens([x.translate(LOWER) for x in texts[a:b]])
        rolling = Rolling(t.values, BASES[1])
        n = len(t.values)
        grams = mix(rolling.of(np.arange(max(0, n - size + 1)), size))
        ends = np.cumsum(t.counts)
        for start, end in zip((ends - t.counts).tolist(), ends.tolist()):
            if end - start >= size:
                s = np.sort(grams[start : end - size + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            elif end > start:
                whole = rolling.of(np.array([start]), end - start)
                out.append(mix(whole + np.uint64(end - start)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def least_overlap(n: np.ndarray | int, percent: int):
    return -(-percent * n // 100)


def _to_blocks(docs: DataFrame, n_parts: int, size: int) -> DataFrame:
    names, n_blocks = docs.columns, BLOCKS * n_parts
    schema = StructType([*docs.schema.fields, StructField("__sig", StringType()), StructField("__block", IntegerType()), StructField("__copy", BooleanType()), StructField("__n", LongType())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        seen: dict[bytes, int] = {}  # by digest, the least id so far in this task
        for batch in parts:
            texts = batch.column(at).to_pylist()
            ids = [order_id(i) for i in batch.column(names.index("doc_id")).to_pylist()]
            sets = shingle_sets(utf8(texts), size)
            sigs = [digest(s.tobytes()) for s in sets]
            copy = later_ones(sigs, ids, seen)
            copy = [c and len(s) > 0 for c, s in zip(copy, sets)]
            cols = list(batch.columns)
            cols[at] = pa.array([None if c else t for t, c in zip(texts, copy)], pa.string())
            # rows that aren't the first of their set need no block, nor do sets without members, which aren't alike
            keys = [spread(i) if c or not len(s) else int.from_bytes(g[8:12], "little") for c, s, g, i in zip(copy, sets, sigs, ids)]
            names_of = [g.hex() if len(s) else f"empty{i}" for g, s, i in zip(sigs, sets, ids)]
            extra = [pa.array(names_of), pa.array([k % n_blocks for k in keys], pa.int32()), pa.array(copy, pa.bool_()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *extra], [*names, "__sig", "__block", "__copy", "__n"])

    return docs.mapInArrow(run, schema).repartition(n_parts, "__block")


def _firsts(table) -> dict[str, int]:
    """By digest, the row of the first document with that set, of sets with members."""
    found: dict[str, int] = {}
    ids = table.column("doc_id").to_pylist()
    for i, (s, c, n) in enumerate(zip(*(table.column(k).to_pylist() for k in ("__sig", "__copy", "__n")))):
        if not c and n and (s not in found or order_id(ids[i]) < order_id(ids[found[s]])):
            found[s] = i
    return found


def _sets_in_blocks(docs: DataFrame, size: int, percent: int, keep_text: bool) -> DataFrame:
    """All rows of docs with __sig, __n, __first; for sets that may link, on their first row, __r (n-grams found in several sets), __prefix (of those, in order) and __set (those, sorted)."""
    n_parts = shuffle_partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    blocks = _to_blocks(docs, n_parts, size)
    names = [c for c in docs.columns if keep_text or c != "text"]

    def hashes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        seen: set[str] = set()
        for batch in parts:
            where, column = batch.column("__block").to_pylist(), batch.column("text")
            use = []
            for i, (s, c, n) in enumerate(zip(*(batch.column(k).to_pylist() for k in ("__sig", "__copy", "__n")))):
                if not c and n and s not in seen:
                    seen.add(s)
                    use.append(i)
            for i, s in zip(use, shingle_sets(utf8([column[i].as_py() for i in use]), size)):
                found.setdefault(where[i], []).append(s)
        for block in list(found):
            yield block_hashes(np.concatenate(found.pop(block)), block, n_parts, "<u4")
        give_back()

    known = blocks.mapInArrow(hashes, HASHES).repartitionById(n_parts, F.col("bucket")).mapInArrow(count_narrow_hashes, ANSWERS)
    extra = [StructField("__sig", StringType()), StructField("__n", LongType()), StructField("__first", BooleanType()), StructField("__r", LongType()), StructField("__prefix", ArrayType(LongType())), StructField("__set", BinaryType())]
    schema = StructType([*[f for f in docs.schema.fields if f.name in names], *extra])

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, counts = answers(right, "<u4")
        first = _firsts(left)
        texts, sizes = left.column("text"), left.column("__n").to_pylist()
        cols: dict[str, list] = {k: [None] * left.num_rows for k in ("r", "prefix", "set")}
        rows = list(first.values())
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            for i, s in zip(part, shingle_sets(utf8([texts[i].as_py() for i in part]), size)):
                at = look_up(keys, bucket_of(s, n_parts) << np.uint64(32) | s & np.uint64((1 << 32) - 1))
                hit = np.flatnonzero(at >= 0)
                own = len(s) - len(hit)
                width = len(s) - least_overlap(len(s), percent) + 1 - own
                if width > 0:
                    order = hit[np.lexsort((s[hit], counts[at[hit]]))][:width]
                    cols["r"][i], cols["prefix"][i], cols["set"][i] = len(hit), s[order].view(np.int64), s[hit].tobytes()
        isfirst = np.array([n == 0 for n in sizes], bool)
        isfirst[rows] = True
        arrays = [*[left.column(k) for k in names], left.column("__sig"), left.column("__n"), pa.array(isfirst), pa.array(cols["r"], pa.int64()), pa.array(cols["prefix"], pa.list_(pa.int64())), pa.array(cols["set"], pa.binary())]
        return pa.table(arrays, [*names, "__sig", "__n", "__first", "__r", "__prefix", "__set"])

    return blocks.groupBy("__block").cogroup(known.repartition(n_parts, "block").groupBy("block")).applyInArrow(prefixes, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of digests, those that link."""
    left = sets.select(F.col("__sig").alias("a"), F.col("__set").alias("set_a"), F.col("__n").alias("n_a"))
    right = sets.select(F.col("__sig").alias("b"), F.col("__set").alias("set_b"), F.col("__n").alias("n_b"))

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            good = []
            sizes = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()).tolist()
            for x, y, n in zip(batch.column("set_a"), batch.column("set_b"), sizes):
                x, y = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (n - common))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b", "n_a", "n_b").mapInArrow(check, "a string, b string")


def _may_link(percent: int, x: str, y: str) -> str:
    """Bounds on size, and on what two sets can have in common: no more than the n-grams of either that are found in several sets."""
    most = f"least({x}__r, {y}__r)"
    return f"100 * least({x}__n, {y}__n) >= {percent} * greatest({x}__n, {y}__n) AND 100 * {most} >= {percent} * ({x}__n + {y}__n - {most})"


def _against_hubs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(hub, x) -> with __h and __c, the n-grams of the hub and those that x has too (all of those found in several sets),
    __beside, the others of x, and __lacks, the others of the hub where x has so many in common that it may matter."""
    hubs = sets.select(F.col("__sig").alias("hub"), F.col("__set").alias("set_h"))
    own = sets.select(F.col("__sig").alias("x"), F.col("__set").alias("set_x"), "__n")
    schema = "hub string, x string, __h long, __c long, __lacks array<long>, __beside array<long>"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for h, x, n in zip(batch.column("set_h"), batch.column("set_x"), batch.column("__n").to_pylist()):
                h, x = np.frombuffer(h.as_py(), "<u8"), np.frombuffer(x.as_py(), "<u8")
                beside = np.setdiff1d(x, h, assume_unique=True)
                c = len(x) - len(beside)
                lacks = np.setdiff1d(h, x, assume_unique=True).view(np.int64) if c >= least_overlap(n, percent) else None
                rows.append((len(h), c, lacks, beside.view(np.int64)))
            cols = list(zip(*rows)) or [[]] * 4
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("x"), *arrays], ["hub", "x", "__h", "__c", "__lacks", "__beside"])

    return pairs.join(own, "x").join(hubs, "hub").select("hub", "x", "set_h", "set_x", "__n").mapInArrow(run, schema)


def _still_open(entries: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of sets of different components that share a hub: (links that are certain, pairs that have to be verified).

    entries: hub, x, __n, __r, __root, __h, __c, __lacks, __beside. Two sets link if they have q (n + n') in common, q being
    percent / (100 + percent); what they have in common is c + c' - h, and what both lack, and what both have beside. So

    - if c + c' - h >= q (n + n') they link. Then both link with the set under the hub of least q n - c: certain links.
    - otherwise, if both have at least percent n in common with the hub (are near), they share a difference from it: an
      n-gram that both lack or both have beside.
    - otherwise they share an n-gram that both have beside, as c + c' - h and what both lack are not over the lesser c.

    Sets are grouped by (hub, kind, n-gram) and by the numbers that bounds use. Within a set the n-grams are ordered, rare
    ones first: at the first that two sets share, as many must be left in either as they must share. n-grams that only
    sets of one component hold tell nothing.
    """
    p, total = percent, 100 + percent
    q = f"{p} * __n - {total} * __c"
    tops = entries.groupBy("hub").agg(F.min_by("x", F.expr(q)).alias("z"), F.min(F.expr(q)).alias("__best"))
    tops = tops.select(F.col("hub").alias("__of"), "z", "__best")
    entries = entries.join(tops, F.col("hub") == F.col("__of")).drop("__of").withColumn("__near", F.expr(f"100 * __c >= {p} * __n"))
    certain = entries.filter(f"x <> z AND {q} + __best + {total} * __h <= 0").select(F.col("z").alias("a"), F.col("x").alias("b"))
    # how many of its differences a set must share at the least, by kind: 0 with near sets, 1 with others
    kinds = F.array(
        F.when(F.col("__near"), F.struct(F.lit(0).alias("kind"), F.concat("__lacks", "__beside").alias("of"), F.expr(f"ceil(({q} + __best + {total} * __h) / {total})").alias("least"))),
        F.struct(F.lit(1).alias("kind"), F.col("__beside").alias("of"), F.expr(f"ceil(({p} * __n - 100 * __c) / 100)").alias("least")),
    )
    facts = ["hub", "kind", "d", "__n", "__r", "__h", "__c", "__near"]
    of = entries.withColumn("k", F.explode(F.filter(kinds, lambda k: k.isNotNull()))).select("hub", "x", "__n", "__r", "__h", "__c", "__near", "__root", F.col("k.kind").alias("kind"), F.col("k.least").alias("least"), F.explode("k.of").alias("d"))
    of = cut(of)
    often = of.groupBy("hub", "kind", "d").agg(F.count(F.lit(1)).alias("often"), F.min("__root").alias("r0"), F.max("__root").alias("r1")).filter("r0 <> r1").drop("r0", "r1")
    order = Window.partitionBy("hub", "kind", "x").orderBy(F.desc("often"), "d")
    every = Window.partitionBy("hub", "kind", "x")
    of = of.join(often, ["hub", "kind", "d"]).withColumn("__left", F.row_number().over(order))
    of = of.withColumns({"__size": F.count(F.lit(1)).over(every), "__bits": F.bit_or(F.expr("shiftleft(1L, pmod(hash(d), 64))")).over(every)})
    of = of.filter("__left >= least").drop("often", "least")
    of = cut(of.withColumn("group", F.xxhash64(*facts, "__left")))
    groups = of.groupBy("group", *facts, "__left").agg(F.min("__root").alias("__r0"), F.max("__root").alias("__r1"))
    left, right = groups.select(*[F.col(c).alias(f"a{c}") for c in groups.columns]), groups.select(*[F.col(c).alias(f"b{c}") for c in groups.columns])
    need = f"{p} * (a__n + b__n)"
    bounds = [
        "ahub = bhub AND akind = bkind AND ad = bd AND agroup <= bgroup AND least(a__r0, b__r0) <> greatest(a__r1, b__r1)",
        _may_link(percent, "a", "b"),
        f"{need} <= {total} * (least(a__c, b__c) + least(a__r - a__c, b__r - b__c))",
        f"CASE WHEN akind = 0 THEN {need} <= {total} * (a__c + b__c - a__h + least(a__left, b__left)) ELSE NOT (a__near AND b__near) AND {need} <= {total} * (least(a__c, b__c) + least(a__left, b__left)) END",
    ]
    met = left.join(right, F.expr(" AND ".join(f"({b})" for b in bounds))).select("ahub", "akind", "ad", "agroup", "bgroup", F.col("a__h").alias("ah"), *[F.col(f"{s}__{c}").alias(f"{s}{c}") for s in "ab" for c in "nc"])
    members = of.select("hub", "kind", "d", "group", "x", "__root", "__size", "__bits")
    # bits of the differences: those that only one of two sets has set are at least as many n-grams that the other hasn't
    both = "least(a_size - bit_count(a_bits & ~b_bits), b_size - bit_count(b_bits & ~a_bits))"
    further = f"a_root <> b_root AND {p} * (an + bn) <= {total} * ({both} + CASE WHEN akind = 0 THEN ac + bc - ah ELSE least(ac, bc) END)"
    for s, more in (("a", "true"), ("b", further)):
        one = members.select(*[F.col(c).alias(f"m{c}") for c in ("hub", "kind", "d", "group")], F.col("x").alias(s), *[F.col(f"__{c}").alias(f"{s}_{c}") for c in ("root", "size", "bits")])
        on = f"ahub = mhub AND akind = mkind AND ad = md AND {s}group = mgroup AND ({more})"
        met = met.join(one, F.expr(on)).drop("mhub", "mkind", "md", "mgroup")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return certain, pairs


def _linked(docs: DataFrame, size: int, percent: int, keep_text: bool) -> DataFrame:
    """All rows of docs with __sig, __n, __first and __component."""
    rows = _sets_in_blocks(docs, size, percent, keep_text)
    rows = cut(rows.filter("__first") if keep_text else rows)  # with texts, only first rows are asked for
    release(docs.sparkSession)
    sets = rows.filter("__set IS NOT NULL").select("__sig", "__n", "__r", "__set", "__prefix")
    grouped = sets.select("__sig", "__n", "__r", "__prefix", F.sha2(F.concat_ws(",", F.col("__n").cast("string"), F.col("__r").cast("string"), F.array_join("__prefix", ",")), 256).alias("__group"))
    grouped = cut(grouped)
    # members against the first of their group
    groups = cut(grouped.groupBy("__group").agg(F.min("__sig").alias("__head"), F.first("__n").alias("__n"), F.first("__r").alias("__r"), F.first("__prefix").alias("__prefix")))
    inside = grouped.join(groups.select("__group", "__head"), "__group").filter("__sig <> __head").select(F.col("__head").alias("a"), F.col("__sig").alias("b"))
    # groups against the hub of each n-gram
    index = groups.select("__head", "__n", "__r", F.explode("__prefix").alias("__gram"))
    hubs = index.groupBy("__gram").agg(F.min(F.struct((F.col("__n") - F.col("__r")).alias("own"), (-F.col("__n")).alias("small"), F.col("__head").alias("hub"), F.col("__n").alias("h__n"), F.col("__r").alias("h__r"))).alias("__hub"))
    hubs = cut(hubs.select(F.col("__gram"), "__hub.hub", "__hub.h__n", "__hub.h__r"))
    between = index.join(hubs, "__gram").filter("__head <> hub").filter(_may_link(percent, "", "h")).select(F.col("hub").alias("a"), F.col("__head").alias("b"))
    between = between.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = cut(_verified(inside.union(between).distinct(), sets, percent))
    release(docs.sparkSession)  # the sets were shuffled for both sides of the pairs
    roots = components(links)
    # what may still join two components
    named = grouped.join(roots, F.col("__sig") == F.col("node"), "left").select(F.col("__sig").alias("x"), "__n", "__r", F.coalesce("root", "__sig").alias("__root"), F.explode("__prefix").alias("__gram"))
    named = cut(named)
    mixed = named.groupBy("__gram").agg(F.min("__root").alias("r0"), F.max("__root").alias("r1")).filter("r0 <> r1").select("__gram")
    entries = cut(named.join(mixed.join(hubs, "__gram").select("__gram", "hub"), "__gram").select("hub", "x", "__n", "__r", "__root").distinct())
    if not entries.isEmpty():
        entries = cut(entries.join(_against_hubs(entries.select("hub", "x"), sets, percent), ["hub", "x"]))
        release(docs.sparkSession)
        certain, met = _still_open(entries, percent)
        more = cut(certain.union(_verified(met, sets, percent)))
        if not more.isEmpty():
            roots = components(links.union(more))
    # the least document of each component; a set's least document is the first of its rows
    firsts = rows.filter("__first AND __n > 0").select("__sig", F.col("doc_id").alias("__min"))
    least = roots.join(firsts.withColumnRenamed("__sig", "node"), "node")
    top = least.groupBy("root").agg(F.min("__min").alias("__component"))
    top = least.select("node", "root").join(top, "root").select(F.col("node").alias("__of"), "__component")
    out = rows.drop("__r", "__prefix", "__set")
    if keep_text:  # a first row's set has its own id: only sets with links are looked up, and texts needn't be shuffled for few
        found = cut(top)  # its size is known then, before anything is shuffled for it
    else:
        found = firsts.join(top, F.col("__sig") == F.col("__of"), "left").select(F.col("__sig").alias("__of"), F.coalesce("__component", "__min").alias("__component"))
    out = out.join(found, F.col("__sig") == F.col("__of"), "left").drop("__of")
    return out.withColumn("__component", F.coalesce("__component", F.when(F.col("__first") | (F.col("__n") == 0), F.col("doc_id"))))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """All rows and columns of docs but text, with n_shingles and component_id (the least doc_id that links reach)."""
    out = _linked(docs.drop("n_shingles", "component_id"), size, percent, False)
    return out.withColumnsRenamed({"__n": "n_shingles", "__component": "component_id"}).drop("__sig", "__first")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that come first in their component, with all columns; texts without words all stay."""
    release(docs.sparkSession)  # what the caller's earlier work left, before texts are shuffled
    out = _linked(docs, size, percent, True)
    return out.filter(F.col("__component").eqNullSafe(F.col("doc_id"))).select(*docs.columns)
