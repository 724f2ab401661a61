"""SentencePiece BPE encoding by a table of prefixes, and decoding.

A BPE encoding has two properties.  Each prefix of a text has one last token, whatever follows; and a row of tokens is
an encoding exactly if each two neighbours are one.  So one pass over the vocabulary matches of an automaton fills a
table with the last token of each prefix: of the pieces that end there, the one that is compatible with the last token
of the prefix before it.  The ids are then read backwards from the end.  Work is linear in the text's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .text import with_column

SPACE = "▁"
CACHED_WORDS = 200_000
CACHED_PAIRS = 300_000
SLICE = 512  # rows of a batch that are Python objects at one time
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces, as model files number them


@dataclass(frozen=True)
class PieceModel:
    """The vocabulary of a BPE model, by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    begin: int
    end: int
    unknown_text: str


def read_model(path: str) -> PieceModel:
    """The vocabulary in a model file, which the driver reads (a vocabulary is bounded).

    Only what these operators reproduce exactly is taken: BPE with byte fallback, texts left as they are but for one
    space in front, no pieces that users defined and none marked unused.
    """
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(path, "rb") as f:
        model = schema.ModelProto.FromString(f.read())
    trainer, normalizer = model.trainer_spec, model.normalizer_spec
    kinds = tuple(p.type for p in model.pieces)
    fits = {
        "BPE": trainer.model_type == schema.TrainerSpec.BPE,
        "byte fallback": trainer.byte_fallback,
        "no normalisation": not normalizer.precompiled_charsmap and not normalizer.remove_extra_whitespaces,
        "a space in front": normalizer.add_dummy_prefix and not trainer.treat_whitespace_as_suffix,
        "plain pieces": set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE},
    }
    if not all(fits.values()):
        raise ValueError(f"a model without {', '.join(k for k, v in fits.items() if not v)} is not supported")
    return PieceModel(
        tuple(p.piece for p in model.pieces),
        tuple(p.score for p in model.pieces),
        kinds,
        trainer.bos_id,
        trainer.eos_id,
        trainer.unk_surface,
    )


class PairTest(dict):
    """(left, right): whether merging the characters of both gives just these two tokens."""

    def __init__(self, scores: dict[str, float]):
        super().__init__()
        self.scores = scores

    def __missing__(self, pair: tuple[str, str]) -> bool:
        if len(self) >= CACHED_PAIRS:
            self.clear()
        value = self[pair] = self._merges_to(*pair)
        return value

    def _merges_to(self, left: str, right: str) -> bool:
        """Merge the best pair, the leftmost of equal ones, until none is a piece or a merge crosses the border."""
        symbols, border, score = [*left, *right], len(left), self.scores.get
        while len(symbols) > 1:
            values = [score(a + b, -np.inf) for a, b in zip(symbols, symbols[1:])]
            best = max(values)
            if best == -np.inf:
                break
            at = values.index(best)
            if at == border - 1:
                return False
            border -= at < border
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return len(symbols) == (left != "") + (right != "")


class WordIds(dict):
    """Word to its token ids as little-endian 32-bit bytes; a word is a run that no token crosses."""

    def __init__(self, model: PieceModel):
        super().__init__()
        normal = [i for i, kind in enumerate(model.kinds) if kind == NORMAL]
        self.older: dict[str, bytes] = {}
        self.ids = {model.pieces[i]: i for i in normal}
        self.code = {piece: np.array([i], "<u4").tobytes() for piece, i in self.ids.items()}
        self.fallback = [np.array([i], "<u4").tobytes() for i, kind in enumerate(model.kinds) if kind == BYTE]
        self.compatible = PairTest({model.pieces[i]: model.scores[i] for i in normal})
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.compatible[piece, ""]:  # some pieces are never the result of merges
                self.automaton.add_word(piece, (piece, len(piece)))
        self.automaton.make_automaton()
        self.word = re.compile(self._pattern())

    def _pattern(self) -> str:
        """Words: runs of characters that pieces have next to each other, with the spaces before them.

        Where a piece has a space after another character, spaces are characters like any other.
        """
        longer = [p for p in self.ids if len(p) > 1]
        in_front = not any(SPACE in p.lstrip(SPACE) for p in longer)
        groups: dict[str, set[str]] = {}
        for piece in longer:
            group = set(piece.lstrip(SPACE) if in_front else piece)
            for c in list(group):
                group |= groups.get(c, set())
            for c in group:
                groups[c] = group
        sets = {id(g): g for g in groups.values() if len(g) > 1}.values()
        before = f"{SPACE}*" if in_front else ""
        runs = [f"{before}[{''.join(map(re.escape, sorted(g)))}]+" for g in sorted(sets, key=len, reverse=True)]
        return "|".join([*runs, f"{before}[^{SPACE}]", f"{SPACE}+"])

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.older = dict(self)
            self.clear()
        value = self.older.get(word) or self._encode(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def _encode(self, word: str) -> bytes:
        last: list[str | None] = [None] * (len(word) + 1)  # the last token of each prefix; none: its last character
        compatible = self.compatible
        for at, (piece, size) in self.automaton.iter(word):
            if last[at + 1] is None:
                begin = at + 1 - size
                if not begin or compatible[last[begin] or word[begin - 1], piece]:
                    last[at + 1] = piece
        parts, end = [], len(word)
        while end:
            piece = last[end] or word[end - 1]
            parts.append(self.code.get(piece) or b"".join(self.fallback[b] for b in piece.encode()))
            end -= len(piece)
        return b"".join(reversed(parts))

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.__getitem__, self.word.findall(SPACE + text.replace(" ", SPACE))))


class Decoder:
    """Token ids to text."""

    def __init__(self, model: PieceModel):
        self.kinds = model.kinds
        self.spaced = [kind == NORMAL and p.startswith(SPACE) for p, kind in zip(model.pieces, model.kinds)]
        self.table = [self._surface(model, i) for i in range(len(model.pieces))]
        self.controls = [i for i, kind in enumerate(model.kinds) if kind == CONTROL]

    @staticmethod
    def _surface(model: PieceModel, i: int) -> bytes:
        piece, kind = model.pieces[i], model.kinds[i]
        if kind == BYTE:
            return bytes([int(piece[3:-1], 16)])
        return {CONTROL: "", UNKNOWN: model.unknown_text}.get(kind, piece.replace(SPACE, " ")).encode()

    def decode(self, ids: np.ndarray) -> str:
        """Control ids give nothing, the space in front of the first token goes, bytes that are no UTF-8 give U+FFFD."""
        at = np.flatnonzero(~np.isin(ids, self.controls))
        if not len(at):
            return ""
        shown = ids[at[0] : at[-1] + 1].tolist()
        skip = self.spaced[shown[0]]
        if len(shown) == len(at):  # else a control id may end a run of bytes
            try:
                return b"".join(map(self.table.__getitem__, shown)).decode()[skip:]
            except UnicodeDecodeError:
                pass
        return self._decode_runs(shown)[skip:]

    def _decode_runs(self, ids: Sequence[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == BYTE:
                run += self.table[i]
                continue
            out.append(_valid_characters(bytes(run)))
            run.clear()
            if i is not None:
                out.append(self.table[i].decode())
        return "".join(out)


def _valid_characters(run: bytes) -> str:
    """The characters of a run of bytes; each byte that begins none is replaced."""
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, SLICE) for batch in batches for i in range(0, batch.num_rows, SLICE))


@lru_cache(1)
def _encoder(model: PieceModel) -> WordIds:
    return WordIds(model)


@lru_cache(1)
def _decoder(model: PieceModel) -> Decoder:
    return Decoder(model)


def encode(docs: DataFrame, model: PieceModel, text: str = "text", ids: str = "ids", marks: bool = True) -> DataFrame:
    """The rows with ``ids``: the token ids of each whole text as little-endian unsigned 32-bit integers, one binary.

    A null or empty text has no ids but the begin and end marks (``marks``).  Very long texts are encoded whole, in
    memory of a few times their size; a long run without any space takes a table as long as itself.  No shuffle; an
    empty table gives no rows.  Further columns stay; one named like ``ids`` is an error.
    """
    if ids.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have a column {ids} already")
    begin, end = (np.array([i], "<u4").tobytes() if marks else b"" for i in (model.begin, model.end))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model)
        for batch in _slices(batches):
            values = [begin + encoder.encode(t or "") + end for t in batch.column(text).to_pylist()]
            yield with_column(batch, ids, pa.array(values, pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.BinaryType())]))


def decode(tokens: DataFrame, model: PieceModel, ids: str = "ids", text: str = "text") -> DataFrame:
    """The rows with ``text``: the text of ``ids`` (little-endian unsigned 32-bit integers; null: null).

    An id outside of the vocabulary raises.  Further columns stay; one named like ``text`` is an error.
    """
    if text.lower() in {c.lower() for c in tokens.columns}:
        raise ValueError(f"the tokens have a column {text} already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(model)
        for batch in _slices(batches):
            rows = batch.column(ids).to_pylist()
            values = [None if r is None else decoder.decode(np.frombuffer(r, "<u4")) for r in rows]
            yield with_column(batch, text, pa.array(values, pa.string()))

    return tokens.mapInArrow(run, T.StructType([*tokens.schema.fields, T.StructField(text, T.StringType())]))
