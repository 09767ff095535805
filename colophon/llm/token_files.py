"""Token ids in files of fixed-width packed blocks.

Each id takes the least number of bits that holds the vocabulary. A file is a Parquet table of blocks, so any store that
Spark reaches can hold it; ascending (part, block) is the order of the corpus. A block holds some whole documents: their
ids and counts, the number of tokens before it in its part, and the ids of all of them packed back to back. A document
starts at a bit that the counts give, so numpy unpacks a block, or any document in it, without reading the rest.

Parts are ranges of doc_id, cut at approximate quantiles; the tokens before a part come from one number per part.

Defined cases: a null text is empty and has the end id alone; null doc_ids come last; rows with the same doc_id stand
side by side, ordered by their ids; an empty table gives no blocks and an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import packed
from .common import give_back, shared_dir, shuffle_partitions, small_batches

BLOCK_IDS = 1 << 19

BLOCK_SCHEMA = "part int, block int, tokens_before long, n_tokens long, width int, doc_ids array<long>, counts array<long>, packed binary"


def bits_for(vocabulary: int) -> int:
    return max(1, (max(vocabulary, 1) - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each id, least significant first, back to back."""
    ids = np.ascontiguousarray(ids, "<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes, width: int, n: int, start: int = 0) -> np.ndarray:
    """n ids from the one at ``start``; only the bytes that hold them are touched."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", n, start * (width // 8)).astype(np.uint32)
    first, last = start * width // 8, ((start + n) * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(packed, np.uint8)[first:last], bitorder="little")[start * width - 8 * first :][: n * width].reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel().astype(np.uint32)


#: Pieces of texts whose ids a worker keeps, twice (a generation and the one before it). They go when its task ends.
KNOWN = 400_000
#: Bytes of the longest piece that is kept.
LONGEST = 64
#: Bytes of texts that are cut together, but for one text that is longer.
TOGETHER = 1 << 21
#: Words that go to the model as one, and how many of these at once.
JOINED, AT_ONCE = 48, 16

#: What a byte is to the pattern: of a letter, a digit or a mark; of a character that isn't white, but which of these, or whether
#: it is tied to letters, isn't told; a space; other white space; 0 where nothing is told.
LETTER, DIGIT, MARK, OTHER, SPACE, WHITE = range(1, 7)

_ENCODERS: dict = {}


def _kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[33:127] = MARK
    kinds[39] = OTHER  # the apostrophe
    for b in range(128):
        if chr(b).isalpha():
            kinds[b] = LETTER
    kinds[48:58] = DIGIT
    kinds[32] = SPACE
    kinds[[9, 10, 13]] = WHITE
    kinds[128:] = OTHER
    kinds[0xC3:0xC9] = kinds[0xD0:0xD2] = LETTER  # they begin U+00C0 to U+023F and U+0400 to U+047F: letters but for two
    return kinds


KINDS = _kinds()
#: Spaces of more than a byte, as numbers of their first three bytes, the third 0 where there are two.
SPACES = [int.from_bytes(c.encode().ljust(3, b"\0"), "big") for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))]


def cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes at which GPT-2's pattern ends a match whatever stands around them; the starts of texts are among them.

    ``starts`` and ``ends`` are those of the texts that aren't empty. There is a cut between a letter, a digit and a mark;
    before white space with a character that isn't white before or after it (a space begins the match of what follows it);
    and before such a character after other white space than a space. White space that ends a piece is one match both in its
    text and alone, so a piece alone gives the matches that it has in its text.
    """
    kind = KINDS[data]
    lead = np.flatnonzero((kind == LETTER) & (data > 127))
    kind[lead + 1] = LETTER
    signs = lead[(data[lead] == 0xC3) & np.isin(data[lead + 1], (0x97, 0xB7))]  # U+00D7 and U+00F7
    kind[signs] = kind[signs + 1] = OTHER
    for lead, n in ((np.flatnonzero(data == 0xC2), 2), (np.flatnonzero((data >= 0xE1) & (data <= 0xE3)), 3)):
        number = data[lead].astype(np.int32) << 16 | data[lead + 1].astype(np.int32) << 8 | (data[lead + 2] if n == 3 else 0)
        lead = lead[np.isin(number, SPACES)]
        for i in range(n):
            kind[lead + i] = 0
    told, dark, white = (kind > 0) & (kind < OTHER), (kind > 0) & (kind < SPACE), kind >= SPACE
    after = np.append(dark[1:], False)
    after[ends - 1] = False
    cut = np.empty(len(data), bool)
    cut[1:] = told[1:] & told[:-1] & (kind[1:] != kind[:-1]) | dark[1:] & (kind[:-1] == WHITE) | white[1:] & (dark[:-1] | after[1:])
    cut[starts] = True
    return np.flatnonzero(cut)


class PieceEncoder:
    """Texts to ids, many at a time, as little-endian 32-bit numbers.

    Texts are cut at ``cuts``; of each different piece the ids are asked for once, and those of short pieces lately met are kept.
    ``encode_words`` gives the ids of words of letters, each after a space; ``encode_texts`` those of other pieces.
    """

    def __init__(self, encode_words, encode_texts, most: int = KNOWN):
        self.encode_words, self.encode_texts, self.most = encode_words, encode_texts, most
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def forget(self) -> None:
        self.young, self.old = {}, {}
        give_back()

    def _learn(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces of which ``young`` knows none; it gets to know the short ones."""
        found = [self.old.pop(p, None) for p in pieces] if self.old else [None] * len(pieces)
        words, of_words, others, of_others = [], [], [], []
        for i, p in enumerate(pieces):
            if found[i] is not None:
                continue
            if p[:1] == b" " and (word := p[1:].decode()).isalpha():
                words.append(word)
                of_words.append(i)
            else:
                others.append(p.decode())
                of_others.append(i)
        for of, coded in ((of_words, self.encode_words(words)), (of_others, self.encode_texts(others))):
            for i, x in zip(of, coded):
                found[i] = x
        self.young.update((p, x) for p, x in zip(pieces, found) if len(p) <= LONGEST)
        return found

    def batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of an array of large strings without nulls."""
        n = len(texts)
        bounds = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        if bounds[0] == bounds[-1]:
            return [np.zeros(0, "<u4")] * n
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        full = bounds[1:] > bounds[:-1]
        at = cuts(data, bounds[:-1][full], bounds[1:][full])
        coded = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        different, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = list(map(self.young.get, different))
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self._learn([different[i] for i in new])):
            found[i] = x
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        first, size = np.cumsum(sizes) - sizes, sizes[which]
        ends = np.cumsum(size)
        ids = np.frombuffer(b"".join(found), "<u4")[np.arange(ends[-1]) + np.repeat(first[which] - ends + size, size)]
        edges = np.append(0, ends)[np.searchsorted(at, bounds)].tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:])]


class LibraryEncoder:
    """Texts to ids by the tokenizers library, as it is set up by its file.

    The library cuts a text by its pattern, writes each piece in its byte-level alphabet and gives it to its model. A word of
    letters is one piece, so words that the worker doesn't know yet go to the model as they are, some together: no token
    holds the space that begins a word behind its own first place, or they are given to it again one by one. Other pieces go
    through the whole library, and so do texts that hold the string of an added token, at which the library cuts first, and
    all texts where the file sets up more than GPT-2's pattern and plain merges.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        model = self.tok.model
        self.model = Tokenizer(model)  # without the pattern: each text is one piece
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        # the alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.letters = {b: b if b in plain else next(rest) for b in range(256)}
        if set(map(chr, self.letters.values())) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("another byte-level alphabet")
        pattern = json.loads(self.tok.pre_tokenizer.__getstate__()) if self.tok.pre_tokenizer else {}
        self.known_pattern = pattern.get("type") == "ByteLevel" and pattern.get("use_regex", True) and not pattern["add_prefix_space"] and not (self.tok.normalizer or self.tok.truncation or self.tok.padding)
        self.known_pattern &= type(model).__name__ == "BPE" and not (model.ignore_merges or model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[:1] == chr(self.letters[32])]] = True
        self.encoder = PieceEncoder(self._words, self._texts)

    def forget(self) -> None:
        self.encoder.forget()

    def _model(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of words of letters, some in a text, written in the library's alphabet."""
        space = chr(self.letters[32])
        spelt = [t.replace(" ", space) if t.isascii() else t.encode().decode("latin-1").translate(self.letters) for t in texts]
        return [np.array(x.ids, "<u4") for x in self.model.encode_batch_fast(spelt, add_special_tokens=False)]

    def _texts(self, texts: list[str]) -> list[bytes]:
        return [packed(x.ids) for at in range(0, len(texts), 256) for x in self.tok.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        known: list[bytes] = []
        for at in range(0, len(words), JOINED * AT_ONCE):
            parts = [words[i : i + JOINED] for i in range(at, min(at + JOINED * AT_ONCE, len(words)), JOINED)]
            for part, ids in zip(parts, self._model([" " + " ".join(p) for p in parts])):
                starts = (4 * np.flatnonzero(self.begins[ids])).tolist()
                if len(starts) == len(part):
                    known.extend(map(ids.tobytes().__getitem__, map(slice, starts, [*starts[1:], None])))
                else:
                    known.extend(x.tobytes() for x in self._model([" " + w for w in part]))
        return known

    def batch(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        apart = pa.array(np.full(len(texts), not self.known_pattern))
        for token in self.added:
            apart = pc.or_(apart, pc.match_substring(texts, token))
        ids = self.encoder.batch(pc.if_else(apart, "", texts) if pc.any(apart).as_py() else texts)
        for i in np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist():
            ids[i] = np.frombuffer(self._texts([texts[i].as_py()])[0], "<u4")
        return ids


def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of this worker process, made once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def slices(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Small pieces of a batch, which bound the memory: so many bytes of text, or one text that has more."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def write_token_file(docs: DataFrame, out: str, tokenizer: str, vocabulary: int, end_id: int = 0) -> None:
    """Encodes the texts of docs (doc_id, text) and writes them to the folder ``out`` in ascending doc_id order."""
    spark, width = docs.sparkSession, bits_for(vocabulary)
    n = shuffle_partitions(spark)
    small_batches(spark)
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("double").alias("d")).na.drop().approxQuantile("d", [i / n for i in range(1, n)], 0.002)}) if n > 1 else []
    part = F.lit(len(cuts) + 1) if not cuts else F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))))

    end = np.array([end_id], "<u4")

    def encode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_encoder(tokenizer)
        try:
            for whole in parts:
                for batch in slices(whole):
                    ids = [np.concatenate([i, end]) for i in library.batch(batch.column("text"))]
                    bits = pa.array([pack(i, width) for i in ids], pa.binary())
                    yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), bits], ["part", "doc_id", "n", "ids"])
        finally:
            library.forget()

    coded = docs.select(part.cast("int").alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "part int, doc_id long, n long, ids binary")
    ordered = coded.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "ids")

    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        at = {"part": None, "block": 0, "before": 0, "n": 0}

        def flush():
            total = sum(n for _, n, _ in held)
            packed = b"".join(i for *_, i in held) if width % 8 == 0 else pack(np.concatenate([unpack(i, width, n) for _, n, i in held]), width)
            row = [at["part"], at["block"], at["before"], total, width, [d for d, *_ in held], [n for _, n, _ in held], packed]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            names = ["part", "block", "tokens_before", "n_tokens", "width", "doc_ids", "counts", "packed"]
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)
            at["before"] += total
            at["block"] += 1
            at["n"] = 0
            held.clear()
            return out

        for batch in parts:
            for p, d, n, i in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "n", "ids"))):
                if held and (p != at["part"] or at["n"] >= BLOCK_IDS):
                    yield flush()
                if p != at["part"]:
                    at.update(part=p, block=0, before=0)
                held.append((d, n, i))
                at["n"] += n
        if held:
            yield flush()

    ordered.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(out)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (array of int)."""
    rows = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    before, total = {}, 0
    for part, n in sorted(rows.groupBy("part").agg(F.sum("n_tokens")).collect()):  # a row per part
        before[part], total = total, total + n
    first = F.coalesce(F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")], F.lit(0)) if before else F.lit(0)

    def documents(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for row in batch.to_pylist():
                ids = unpack(row["packed"], row["width"], row["n_tokens"]).astype("<u4")
                counts = np.array(row["counts"], np.int64)
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["tokens_before"] + row["first"]), pa.array(counts), pa.array(crc, pa.int64()), lists],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    rows = rows.withColumn("first", first.cast("long"))
    return rows.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def new_token_folder(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
