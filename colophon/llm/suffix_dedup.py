"""Suffix-array dedup: bytes of passages that occur earlier in the corpus are removed.

Suffixes are taken where winnowing sets an anchor: any ``window`` equal bytes hold the same anchor at the same place. Those
whose first ``gram`` bytes occur twice or more in the corpus (see ``repeats``) are sorted by the deep-shallow method: to a
shallow depth by multikey quicksort over words of eight bytes; the groups that still share a prefix then go into blind
tries, which order them and give the lengths of their common prefixes. The text to the left of an anchor is sorted alike,
read backwards. Both arrays of common prefixes then say which windows around an anchor are equal, byte for byte.

Defined cases: a null text is empty; texts shorter than a window lose nothing; of equal texts the one with the smallest
doc_id (null last) is first, and repeated rows are copies of each other; an empty table gives an empty result. Bytes are
removed, so what remains needn't be valid UTF-8: ``kept_sha256`` is of the bytes, the column text replaces broken
sequences. Other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import runs
from .repeats import Kind, Tokens, byte_tokens, repeated_tokens

OUT = StructType([StructField("text", StringType()), *[StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")], StructField("kept_sha256", StringType())])
SHALLOW = 64


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """How many first bytes agree; ``start`` of them are known to."""
    most = min(len(a), len(b))
    while start < most:
        step = min(32, most - start)
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            d = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return start + step - (d.bit_length() + 7) // 8
        start += step
    return most


def blind_trie(strings: list[bytes], members: list[int], depth: int, order: list[int], common: list[int]) -> None:
    """Appends the members in order, with the common prefix of each and the one before (the first gets -1).

    An inner node holds the place of the first byte in which those below differ, and a branch for each byte there (-1: the
    string ends). A string goes down blindly to a leaf; the leaf shows where the two differ, and there it is put in.
    """
    root: list | int = members[0]  # a leaf is a number; a node is [place, branches, a leaf below]
    for m in members[1:]:
        s, node = strings[m], root
        while not isinstance(node, int):
            place, branches, leaf = node
            nxt = branches.get(s[place] if place < len(s) else -1)
            node = leaf if nxt is None else nxt
        other = strings[node]
        at = common_prefix(s, other, depth)
        mine, theirs = (s[at] if at < len(s) else -1), (other[at] if at < len(other) else -1)
        above, key, node = None, None, root
        while not isinstance(node, int) and node[0] < at:
            above, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        if not isinstance(node, int) and node[0] == at:
            node[1][mine] = m
            continue
        made = [at, {theirs: node, mine: m}, m]
        if above is None:
            root = made
        else:
            above[1][key] = made
    stack: list = [(root, -1)]
    while stack:
        node, lcp = stack.pop()
        if isinstance(node, int):
            order.append(node)
            common.append(lcp)
        else:
            kids = sorted(node[1].items(), reverse=True)
            stack.extend((kid, node[0]) for _, kid in kids[:-1])
            stack.append((kids[-1][1], lcp))


def deep_shallow(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the sorted order of distinct strings, and for each but the first of it the length of its common prefix with the one before."""
    n = len(strings)
    lengths = np.array([len(s) for s in strings], np.int64)
    words = SHALLOW // 8
    padded = np.frombuffer(b"".join(s[:SHALLOW].ljust(SHALLOW, b"\0") for s in strings), ">u8").reshape(n, words)
    order, group = np.arange(n), np.zeros(n, np.int64)  # group: of the strings in order
    common = np.zeros(n, np.int64)
    for w in range(words):
        # quicksort on the next word within each group of equal ones so far
        size = np.bincount(group)
        live = np.flatnonzero(size[group] > 1)
        if not len(live):
            break
        key = padded[order[live], w].astype(np.uint64)
        inner = np.lexsort((key, group[live]))
        order[live] = order[live[inner]]
        key = key[inner]
        differs = (key[1:] != key[:-1]) & (group[live][1:] == group[live][:-1])
        x = key[1:] ^ key[:-1]
        lead = np.where(x == 0, 8, 7 - np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) // 8)
        common[live[1:]] = np.where(differs, 8 * w + lead, common[live[1:]])
        step = np.zeros(n, np.int64)
        step[1:] = group[1:] != group[:-1]
        step[live[1:]] |= differs
        group = np.cumsum(step)
    # padding compares like a zero byte: groups with a string that ends within the shallow depth are ordered by the tries too
    ends = lengths[order] <= SHALLOW
    out_order, out_common = order.tolist(), common.tolist()
    size = np.bincount(group)
    start = np.cumsum(size) - size
    for g in np.flatnonzero(size > 1):
        a, b = int(start[g]), int(start[g] + size[g])
        got: list[int] = []
        lcps: list[int] = []
        depth = 0 if ends[a:b].any() else SHALLOW
        blind_trie(strings, out_order[a:b], depth, got, lcps)
        out_order[a:b] = got
        out_common[a + 1 : b] = lcps[1:]
    done = np.array(out_order, np.int64)
    ends_at = np.minimum(lengths[done], lengths[np.roll(done, 1)])  # no prefix is longer than either string
    return done, np.minimum(np.array(out_common, np.int64), ends_at)


def _sorted(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each string among the distinct ones, common prefixes of the distinct ones in order)"""
    place: dict[bytes, int] = {}
    which = np.array([place.setdefault(s, len(place)) for s in strings], np.int64)
    order, common = deep_shallow(list(place))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[which], common


def equal_windows(spans: np.ndarray, texts: list[bytes], kind: Kind) -> np.ndarray:
    """The class of each window, from the suffix arrays of the text after and (backwards) before each anchor."""
    off, n = spans["off"].astype(np.int64), spans["n"].astype(np.int64)
    after, after_common = _sorted([t[o:] for t, o in zip(texts, off.tolist())])
    before, before_common = _sorted([t[:o][::-1] for t, o in zip(texts, off.tolist())])
    first = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    base = 0
    # left: bytes of the window before the anchor. A window at place j of a span has off - j of them.
    for left in range(int(off.max(initial=0)) + 1):
        j = off - left
        has = np.flatnonzero((j >= 0) & (j < n))
        if not len(has):
            continue
        # strings that share the first d bytes are neighbours in the array: a class ends where the common prefix is shorter
        right_class = np.cumsum(after_common < kind.window - left)[after[has]]
        left_class = np.cumsum(before_common < left)[before[has]] if left else 0
        key = right_class * (len(before_common) + 2) + left_class
        distinct, found = np.unique(key, return_inverse=True)
        out[first[has] + j[has]] = found + base
        base += len(distinct)
    return out


def _finish(t: Tokens, covered: np.ndarray) -> tuple:
    starts, ends = runs(covered)
    kept = b"".join(t.data[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(covered)]))
    return kept.decode("utf-8", "replace"), len(covered), int(covered.sum()), len(starts), hashlib.sha256(kept).hexdigest()


def dedup_suffixes(docs: DataFrame, window: int = 100, gram: int = 40) -> DataFrame:
    """docs with text changed to the remaining bytes, and n_bytes, n_removed, n_spans, kept_sha256."""
    return repeated_tokens(docs, Kind(window, gram, byte_tokens, equal_windows), _finish, OUT)
