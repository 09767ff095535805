"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn: a user's text stands in ``[INST]...[/INST]``, a system's in ``<<SYS>>...<</SYS>>``,
an assistant's before ``</s>``, any other role's in ``<<ROLE name>>...<</ROLE>>``. What is rendered is parsed again by a
deterministic parser and compared with its source. A turn that doesn't come back identical - its text holds a marker, of
whatever kind, or what looks like an escape - is escaped and rendered anew until it does; other texts are left as they are.
An escape is a backslash before a marker's first character or another backslash. The parser always undoes escapes, so it
needs no sign of which texts have them. The loss mask is the spans of the assistants' texts in what was rendered.

At scale: rows are dealt by ranges of (conv_id, turn) and sorted, so a conversation of any size is spread over tasks; each
task renders pieces of at most ``PIECE_TURNS`` turns or ``PIECE_CHARS`` characters. Turns are rendered alike in any piece, so a
conversation's text is its pieces one after another. Reading back parses each piece where it is; only conversations in
several pieces, or at the border of a task, send their pieces to one task, which takes them in order and keeps none: a
digest of a whole conversation can't be made in parts.

Defined cases. A null text, or role, is empty. Turns are in the order of turn (null last), then role, then a hash of the
text, then the text. A null conv_id is a conversation. Repeated rows are turns of their own. Empty tables give empty
results. Texts of any length come back whole. Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions

PIECE_TURNS, PIECE_CHARS = 1024, 1 << 20
Turn = tuple[str, str]

#: What stands before and after a text, by role.
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("", "</s>")}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<<ROLE ", ">>", "<</ROLE>>"
_MARKER = r"\[/?INST\]|<</?SYS>>|</s>|<<ROLE |<</ROLE>>"
#: A marker, or an escape.
CONTROL = re.compile(rf"\\[\\\[<>]|{_MARKER}")
IN_NAME = re.compile(r"\\[\\\[<>]|>>")
#: Before which characters an escape goes: those of markers, and backslashes that would be read as one.
HIDDEN = re.compile(rf"(?={_MARKER})|(?=\\(?:[\\\[<>]|\Z))")
HIDDEN_IN_NAME = re.compile(r"(?=[\\>])")
ESCAPED = re.compile(r"\\([\\\[<>])")


class Malformed(ValueError):
    """Text that the grammar doesn't have."""


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text) if "\\" in text else text


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start and end of the text in it)"""
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = OTHER_OPEN + HIDDEN_IN_NAME.sub(r"\\", role) + OTHER_MID, OTHER_CLOSE
    return head + text + tail, len(head), len(head) + len(text)


def _upto(text: str, at: int, tokens: re.Pattern, mark: str) -> int:
    """Where the next marker stands, which has to be this one; escapes are passed over."""
    for m in tokens.finditer(text, at):
        if m[0][0] != "\\":
            if m[0] != mark:
                raise Malformed(f"{m[0]} at {m.start()} where {mark} should be")
            return m.start()
    raise Malformed(f"{mark} is missing")


def parse_turn(text: str, at: int) -> tuple[str, int, int, int]:
    """(role, start and end of the text, end of the turn) of the turn that starts at a place."""
    for role in ("user", "system"):
        head, tail = MARKS[role]
        if text.startswith(head, at):
            end = _upto(text, at + len(head), CONTROL, tail)
            return role, at + len(head), end, end + len(tail)
    if text.startswith(OTHER_OPEN, at):
        name = at + len(OTHER_OPEN)
        mid = _upto(text, name, IN_NAME, OTHER_MID)
        start = mid + len(OTHER_MID)
        end = _upto(text, start, CONTROL, OTHER_CLOSE)
        return unescape(text[name:mid]), start, end, end + len(OTHER_CLOSE)
    tail = MARKS["assistant"][1]
    end = _upto(text, at, CONTROL, tail)
    return "assistant", at, end, end + len(tail)


def parse(text: str) -> Iterator[tuple[str, int, int]]:
    """(role, start and end of the text) of each turn."""
    at = 0
    while at < len(text):
        role, start, end, at = parse_turn(text, at)
        yield role, start, end


def comes_back(rendered: str, role: str, text: str) -> bool:
    try:
        got, start, end, over = parse_turn(rendered, 0)
    except Malformed:
        return False
    return (got, over) == (role, len(rendered)) and unescape(rendered[start:end]) == text


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text, loss mask) of turns (role, text)."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        rendered, start, end = render_turn(role, text)
        while not comes_back(rendered, role, text):
            hidden = HIDDEN.sub(r"\\", rendered[start:end])
            if len(hidden) == end - start:
                raise Malformed(f"nothing is left to escape in a turn of {role}")
            rendered, start, end = render_turn(role, hidden)
        if role == "assistant":
            mask.append((at + start, at + end))
        parts.append(rendered)
        at += len(rendered)
    whole = "".join(parts)
    if [(role, unescape(whole[a:b])) for role, a, b in parse(whole)] != turns:
        raise Malformed("a conversation doesn't come back")
    return whole, mask


FORMATTED = "conv_id long, piece long, edge boolean, n_turns long, formatted string, loss array<struct<start: int, end: int>>"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("edge", pa.bool_()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN))])
_DIGESTS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
_MIDDLE = pa.schema([_FORMATTED.field("conv_id"), _FORMATTED.field("piece"), *[pa.field(*f) for f in _DIGESTS], _FORMATTED.field("formatted"), _FORMATTED.field("loss")])
_RESULT = pa.schema([_FORMATTED.field("conv_id"), *[pa.field(*f) for f in _DIGESTS]])
MIDDLE = f"conv_id long, piece long, {DIGESTS.partition(', ')[2]}, formatted string, loss array<struct<start: int, end: int>>"


def _batches(rows: Iterator[tuple], schema: pa.Schema, text: int) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; ``text``: the column that is large."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 64 + len(r[text] or "")
        if size >= PIECE_CHARS or len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _rows(batches, *names: str) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            part = b.slice(lo, 256)
            yield from zip(*[part.column(n).to_pylist() for n in names])


def _format(rows: Iterator[tuple], number: int) -> Iterator[tuple]:
    """Sorted (conv_id, role, text) -> rows of FORMATTED; pieces are numbered from ``number`` on."""
    turns: list[tuple[str, str]] = []
    now, size, first, several = None, 0, True, False

    def piece(edge: bool) -> tuple:
        return (now, number, edge, len(turns), *format_turns(turns))

    for conv, role, text in rows:
        if turns and (conv != now or len(turns) >= PIECE_TURNS or size >= PIECE_CHARS):
            several = several or conv == now
            yield piece(first or several)
            number += 1
            if conv != now:
                first = several = False
            turns, size = [], 0
        now = conv
        turns.append((role or "", text or ""))
        size += len(text or "")
    if turns:
        yield piece(True)


def format_conversations(rows: DataFrame) -> DataFrame:
    """The conversations of rows (conv_id, turn, role, text) as rows of FORMATTED: a conversation is its pieces in order.

    ``edge``: other pieces of the conversation may be elsewhere. ``loss``: spans of code points of ``formatted``.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("__hash")]
    dealt = rows.select("conv_id", "turn", "role", "text", F.xxhash64("text").alias("__hash")).repartitionByRange(shuffle_partitions(rows.sparkSession), *order)

    def run(batches):
        from pyspark import TaskContext

        yield from _batches(_format(_rows(batches, "conv_id", "role", "text"), TaskContext.get().partitionId() << 32), _FORMATTED, 4)

    return dealt.sortWithinPartitions(*order, "text").select(F.col("conv_id").cast("long").alias("conv_id"), "role", "text").mapInArrow(run, FORMATTED)


class _Digest:
    """The digests of one conversation, from its pieces in order."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n, self.loss_chars, self.chars = 0, 0, 0

    def add(self, text: str, mask: list[dict]) -> None:
        for role, a, b in parse(text):
            self.turns.update(f"{role}\n{unescape(text[a:b])}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for s in mask:
            under = unescape(text[s["start"] : s["end"]])
            self.loss.update(under.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(under)
        self.chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the rows of DIGESTS: what parsing the pieces of format_conversations gives, and what the loss mask covers."""

    def whole(rows):
        for conv, number, edge, text, mask in rows:
            if edge:
                yield conv, number, None, None, None, None, None, text, mask
            else:
                d = _Digest()
                d.add(text, mask)
                yield conv, number, *d.row(), None, None

    def joined(rows):
        now, digest = None, None
        for conv, n, turns, loss_chars, loss, chars, text, mask in rows:
            if digest is not None and conv != now:
                yield now, *digest.row()
                digest = None
            if text is None:
                yield conv, n, turns, loss_chars, loss, chars
                continue
            now, digest = conv, digest or _Digest()
            digest.add(text, mask)
        if digest is not None:
            yield now, *digest.row()

    names = [n for n in _MIDDLE.names if n != "piece"]
    parts = formatted.mapInArrow(lambda b: _batches(whole(_rows(b, "conv_id", "piece", "edge", "formatted", "loss")), _MIDDLE, 7), MIDDLE)
    parts = parts.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")
    return parts.mapInArrow(lambda b: _batches(joined(_rows(b, *names)), _RESULT, 2), DIGESTS)
