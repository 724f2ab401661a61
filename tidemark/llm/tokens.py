"""Texts as token ids in compressed, checksummed block files, in one global order, and back."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .coder import read_block, write_block
from .text import fresh

END_ID = 2
BLOCK_IDS = 1 << 19
CACHED_PIECES, CACHED_BYTES = 1_000_000, 1 << 26  # of words, and of pieces and their ids; a cache is dropped beyond either
SLICE = 1 << 22  # bytes of text whose words are looked up together
_RUN_OF_SPACE = re.compile(r"\s ")
_LETTER, _DIGIT, _MARK, _SPACE, _WHITE = range(1, 6)  # white: other white space; 0: left to the library


def _kinds() -> np.ndarray:
    """By byte of a UTF-8 text; the letters from U+00C0 on are 0xC3 and a byte from 0x80 to 0xBF."""
    kinds = np.zeros(256, np.uint8)
    kinds[0x21:0x7F] = _MARK
    for low, high, kind in ((0x41, 0x5A, _LETTER), (0x61, 0x7A, _LETTER), (0x30, 0x39, _DIGIT), (0x80, 0xBF, _LETTER)):
        kinds[low : high + 1] = kind
    kinds[0xC3], kinds[0x20] = _LETTER, _SPACE
    kinds[[0x09, 0x0A, 0x0D]] = _WHITE
    return kinds


KINDS = _kinds()


def not_plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of what only the library splits into words: other characters, and what may begin a special token."""
    after = data[1:]
    signs = (data[:-1] == 0xC3) & ((after == 0x97) | (after == 0xB7))
    return np.flatnonzero(KINDS[data] == 0), np.flatnonzero(signs | ((data[:-1] == 0x3C) & (after == 0x7C)))


def word_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the words of plain texts begin, as a byte-level tokenizer splits them; ends: of the texts, none is empty.

    A word is a run of letters, of digits or of marks, with the space before it, if there is one; or one of the
    contractions, which have no space; or white space, whose last character stands alone if more of the text follows.
    """
    kind = KINDS[data]
    white = kind >= _SPACE
    begins = np.concatenate(([0], ends[:-1]))
    before = np.concatenate(([0], kind[:-1])).astype(np.uint8)
    followed = np.concatenate((~white[1:], [False]))
    followed[ends - 1] = False
    start = np.where(white, (before < _SPACE) | followed, (before != _SPACE) & (before != kind))
    start[begins] = True
    at = np.flatnonzero(data == 0x27)
    at = at[start[at]]
    if len(at):
        end = ends[np.searchsorted(ends, at, side="right")]
        padded = np.concatenate((data, [0, 0])).astype(np.int64)
        one, two = padded[at + 1], (padded[at + 1] << 8) + padded[at + 2]
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(np.isin(two, [0x7265, 0x7665, 0x6C6C]), 3, 0))
        size[at + size > end] = 0
        at, size, end = at[size > 0], size[size > 0], end[size > 0]
        start[at + 1] = False
        start[(at + size)[at + size < end]] = True
    return np.flatnonzero(start)


class PieceTokenizer:
    """Token ids with a cache by word, and for texts that are not plain, by space-separated piece.

    A byte-level tokenizer merges within words only, so each word of plain texts is encoded once for many texts.  In
    others it splits before every space that follows another character than white space, so such pieces can be encoded
    each for itself.  Texts with white space before a space, or with what may be a special token, are encoded whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.merger = Tokenizer.from_str(definition), Tokenizer.from_str(definition)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # for what is split into words already
        self.pieces: dict[str, bytes] = {}
        self.held = 0
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.led_by_space = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.led_by_space[[i for token, i in vocabulary.items() if token[:1] == "\u0120"]] = True  # how a space is written
        self.new_line = vocabulary.get("\u010a")
        self._forget()

    def _forget(self) -> None:
        self.words: dict[bytes, int] = {}  # numbers
        self.word_ids, self.word_begins = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _encode(self, text: str, tokenizer: Tokenizer | None = None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _learn_words(self, words: list[bytes]) -> None:
        """Encode new words in few goes: those with a space in front one after another, others as lines."""
        space, led, bare = [], ([], []), ([], [])
        for w in words:
            (space if w.isspace() else (led if w[:1] == b" " else bare)[w.isascii()]).append(w)
        ids, begins = [self._encode(w.decode()) for w in space], [np.zeros(1, np.int64)] * len(space)
        for plain, (spaced, others) in enumerate(zip(led, bare)):
            # A space and a line's end are written as other characters where ASCII words go to the merger.
            tokenizer = self.merger if plain else self.tokenizer
            if spaced:
                text = b"".join(spaced).decode()
                ids.append(self._encode(text.replace(" ", " \u0120") if plain else text, tokenizer))
                begins.append(np.flatnonzero(self.led_by_space[ids[-1]]))
            if others:
                text = b"\n".join(others).decode()
                found = self._encode(text.replace("\n", " \u010a ") if plain else text, tokenizer)
                ends = np.flatnonzero(found == self.new_line)
                ids.append(np.delete(found, ends))
                begins.append(np.concatenate(([0], ends - np.arange(len(ends)))))
        words = [*space, *led[0], *bare[0], *led[1], *bare[1]]
        at = len(self.word_ids) + np.cumsum([0, *map(len, ids)])
        begins = np.concatenate([b + a for b, a in zip(begins, at)])
        if len(begins) != len(words):
            raise ValueError("not a byte-level tokenizer")
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words))))
        self.word_ids = np.concatenate((self.word_ids, *ids))
        self.word_begins = np.concatenate((self.word_begins[:-1], begins, at[-1:]))

    def _of_plain(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of each of some plain texts, none of them empty."""
        if len(self.words) > CACHED_PIECES or 4 * len(self.word_ids) > CACHED_BYTES:
            self._forget()
        starts = word_starts(data, ends)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int32))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = [*map(self.words.get, words)]
        new = [w for w, k in zip(words, numbers) if k is None]
        if new:
            self._learn_words(new)
            numbers = [*map(self.words.__getitem__, words)]
        number = np.array(numbers, np.int64)[coded.indices.to_numpy()]
        begin = self.word_begins[number]
        upto = np.cumsum(self.word_begins[number + 1] - begin)
        size = np.diff(upto, prepend=0)
        ids = self.word_ids[np.repeat(begin - (upto - size), size) + np.arange(upto[-1])]
        return np.split(ids, upto[np.searchsorted(starts, ends) - 1][:-1])

    def ids_of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a column without nulls."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            before = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + SLICE)))
            yield from self._of_slice(texts.slice(begin, end - begin), ends[begin:end] - before)
            begin = end

    def _of_slice(self, texts: pa.Array, ends: np.ndarray) -> list[np.ndarray]:
        data, sizes = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8), np.diff(ends, prepend=0)
        odd = np.zeros(len(texts), bool)
        for places in not_plain(data) if self.new_line is not None else [np.arange(len(data))]:
            odd[np.searchsorted(ends, places, side="right")] = True
        out: list = [np.empty(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(odd).tolist():
            out[i] = np.frombuffer(self.ids(texts[i].as_py()), "<u4")
        plain = np.flatnonzero(~odd & (sizes > 0))
        if len(plain):
            data = data[np.repeat(~odd, sizes)] if odd.any() else data
            for i, ids in zip(plain.tolist(), self._of_plain(data, np.cumsum(sizes[plain]))):
                out[i] = ids
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces in one go: of the ids, those of tokens led by a space begin a piece."""
        ids = self._encode(" " + " ".join(pieces))
        begins = (4 * np.flatnonzero(self.led_by_space[ids])).tolist()
        plain = ids.tobytes()
        self.pieces.update(zip(pieces, (plain[b:e] for b, e in zip(begins, [*begins[1:], len(plain)]))))
        self.held += len(plain) + sum(map(len, pieces))

    def ids(self, text: str) -> bytes:
        """Of any text, by its pieces, as little-endian 32-bit bytes."""
        if "<|" in text or _RUN_OF_SPACE.search(text):
            return self._encode(text).tobytes()
        first, *rest = text.split(" ")
        new = list(set(rest).difference(self.pieces))
        if new:
            if len(self.pieces) > CACHED_PIECES or self.held > CACHED_BYTES:
                self.pieces.clear()
                self.held, new = 0, list(set(rest))
            # An empty piece is a space at the end of the text: at the end it stays a token of its own.
            self._learn([*(p for p in new if p), ""] if "" in new else new)
        return b"".join((self._encode(first).tobytes(), *map(self.pieces.__getitem__, rest)))


@functools.lru_cache(1)
def tokenizer_of(definition: str) -> PieceTokenizer:
    """One for each worker process, so that a task starts with the pieces that earlier ones have met."""
    return PieceTokenizer(definition)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Tokenise the texts and write blocks of ids, in ascending order of the key, as a table of binary blocks.

    One range shuffle of the texts; each task writes the blocks of its range.  A block holds whole documents, about
    ``block_ids`` ids, more only where one document has more.  Null texts count as empty; each document ends with
    ``end``.  Null keys come first, equal keys next to each other.  ``tokenizer`` is the path of a tokenizer file,
    which the driver reads.
    """
    definition = Path(tokenizer).read_text()
    (tie,) = fresh(docs, "_tie")
    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn(tie, F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col(tie).asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before, number = tokenizer_of(definition), TaskContext.get().partitionId(), 0, 0
        mark = np.array([end], np.uint32)
        keys: list = []
        parts: list[np.ndarray] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate([x for p in parts for x in (p, mark)])
            content = write_block(keys, [len(p) + 1 for p in parts], ids)
            columns = [[part], [number], [before], [len(ids)], [content]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)], names=["part", "block", "ids_before", "ids", "content"]
            )

        for batch in batches:
            for name, ids in zip(batch.column("id").to_pylist(), encoder.ids_of(batch.column("text"))):
                keys.append(name)
                parts.append(ids)
                size += len(ids) + 1
                if size >= block_ids:
                    yield block()
                    before, number = before + size, number + 1
                    keys, parts, size = [], [], 0
        if keys:
            yield block()

    blocks = rows.mapInArrow(run, "part int, block bigint, ids_before bigint, ids bigint, content binary")
    blocks.write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files.

    start: ids of all documents before it; the totals of the parts (one row for each) give what comes before each.  A
    damaged block raises.
    """
    names = ["part", "place", "doc_id", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, content in zip(*(batch.column(c).to_pylist() for c in ("part", "ids_before", "content"))):
                keys, lengths, ids = read_block(content)
                ends = np.cumsum(lengths)
                plain = memoryview(ids.astype("<u4").tobytes())
                begins = (ends - lengths).tolist()
                crc = [zlib.crc32(plain[4 * b : 4 * e]) for b, e in zip(begins, ends.tolist())]
                columns = [np.full(len(keys), part), ends - lengths + before, keys, lengths, crc]
                if with_ids:
                    columns.append([ids[b:e] for b, e in zip(begins, ends.tolist())])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    blocks = spark.read.schema("part int, block bigint, ids_before bigint, ids bigint, content binary").parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("ids").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    schema = "part int, place bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    rows = blocks.select("part", "ids_before", "content").mapInArrow(run, schema).join(F.broadcast(totals), "part")
    return rows.select("doc_id", (F.col("offset") + F.col("place")).alias("start"), *names[3:])
