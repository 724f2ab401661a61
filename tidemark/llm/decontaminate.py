"""Benchmark decontamination with a generalised suffix automaton over the words of all test items."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize
from .text import alnum_words, byte_texts, fresh, with_column

WINDOW = 13
# Words of test items in one automaton (some 100 MB in Python); more items are matched in several passes.
BLOCK_WORDS = 200_000

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType(), False)),
        T.StructField("ends", T.ArrayType(T.IntegerType(), False)),
        T.StructField("items", T.ArrayType(T.StringType(), False)),
    ]
)
_FOUND_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("starts", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("items", pa.list_(pa.string())),
    ]
)


class ItemAutomaton:
    """All substrings of the items' word sequences; a state holds the strings that end at the same places.

    ``owners`` names the items of the state that holds a full window, ``whole`` the items shorter than a window by the
    state of their whole text, with their length.
    """

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        owners: dict[int, set[str]] = {}
        whole: dict[int, set[tuple[int, str]]] = {}
        coded = []
        for name, words in items:
            if words:
                coded.append((name, [self.words.setdefault(w, len(self.words)) for w in words]))
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        for name, codes in coded:
            state, size = 0, len(codes)
            for i, c in enumerate(codes):
                state = self.next[state][c]
                if i + 1 >= window:
                    owners.setdefault(self._shortened(state), set()).add(name)
            if size < window:
                whole.setdefault(state, set()).add((size, name))
        self.owners = {s: sorted(names) for s, names in owners.items()}
        self.whole = {s: sorted(names) for s, names in whole.items()}
        self.shortest = min([window, *[m for names in whole.values() for m, _ in names]])

    def _extend(self, last: int, c: int) -> int:
        following = self.next[last].get(c)
        if following is not None and self.length[following] == self.length[last] + 1:
            return following
        if following is not None:
            return self._clone(last, c, following)
        state = self._new(self.length[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][c]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return state

    def _new(self, length: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        """Split off the strings of q that are no longer than one word after p."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _shortened(self, state: int) -> int:
        """The state of the last ``window`` words of a state."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int], set[str]]:
        """(starts, ends) of the maximal hit runs of words, end exclusive, and the items found."""
        n = len(words)
        codes = np.fromiter(map(self.words.get, words, repeat(-1)), np.int32, n)
        unknown = np.concatenate(([-1], np.flatnonzero(codes < 0), [n]))
        starts: list[int] = []
        ends: list[int] = []
        found: set[str] = set()
        # Only runs of known words that hold a whole window can match.
        for k in np.flatnonzero(np.diff(unknown) > self.shortest):
            begin, end = int(unknown[k]) + 1, int(unknown[k + 1])
            for start, stop in self._run(codes[begin:end].tolist(), begin, found):
                while ends and start <= ends[-1] and start <= starts[-1]:
                    starts.pop()
                    ends.pop()
                if ends and start <= ends[-1]:
                    ends[-1] = stop
                else:
                    starts.append(start)
                    ends.append(stop)
        return starts, ends, found

    def _run(self, codes: list[int], begin: int, found: set[str]) -> Iterator[tuple[int, int]]:
        """Hits in the order of their ends: the longest matching length carried from word to word."""
        state = length = 0
        for i, c in enumerate(codes, begin + 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state = self.next[state][c]
                length += 1
            if length >= self.window:
                found.update(self.owners[self._shortened(state)])
                yield i - self.window, i
            if self.whole:
                above = state
                while above > 0:
                    for size, name in self.whole.get(above, ()):
                        if size <= length:
                            found.add(name)
                            yield i - size, i
                    above = self.link[above]


def item_blocks(
    benchmark: DataFrame, item: str, text: str, block_words: int
) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of bounded size; the driver holds one block at a time.  Rows without words are left out."""
    block, size = [], 0
    rows = benchmark.select(F.col(item).cast("string"), F.col(text).cast("binary"))
    for name, content in rows.toLocalIterator():
        words = alnum_words(bytes(content) if content is not None else None)
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append(("" if name is None else name, words))
        size += len(words)
    if block:
        yield block


def _union(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(zip(starts, ends)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [s for s, _ in out], [e for _, e in out]


def _matcher(automaton: ItemAutomaton, name: str, text: str, again: bool):
    """mapInArrow function: adds the column of what is found, or adds to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            before = batch.column(name).to_pylist() if again else repeat(None)
            for content, old in zip(byte_texts(batch, text), before):
                words = alnum_words(content)
                starts, ends, found = automaton.scan(words)
                if old:
                    starts, ends = _union(old["starts"] + starts, old["ends"] + ends)
                    found.update(old["items"])
                out.append({"n_words": len(words), "starts": starts, "ends": ends, "items": sorted(found)})
            if again:
                batch = batch.drop_columns([name])
            yield with_column(batch, name, pa.array(out, _FOUND_ARROW))

    return run


def find_items(
    docs: DataFrame,
    benchmark: DataFrame,
    name: str,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The documents with a struct column ``name``: n_words, starts and ends of the maximal runs of hit words, items.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item; a word inside any occurrence
    of a window is hit.  No shuffle: the automaton of a block of items (``block_words`` at most, so what is
    sent is bounded) goes to every task and each text streams through it once, carrying the longest matching length.  Further
    blocks are further passes over a written table.  Null and empty texts have no words; items without words match
    nothing; items that share an id count once, and those with a null id count together under the empty id.  Very long
    texts are searched whole; no documents give no rows, no items no hits; other columns stay, whatever their names.
    """
    again = False
    for block in item_blocks(benchmark, item, item_text, block_words):
        if again:
            docs = materialize(docs, "hits")
            schema = docs.drop(name).schema
        else:
            schema = docs.schema
        automaton = ItemAutomaton(block, window)
        docs = docs.mapInArrow(_matcher(automaton, name, text, again), T.StructType([*schema.fields, T.StructField(name, FOUND)]))
        again = True
    if not again:
        automaton = ItemAutomaton([], window)
        docs = docs.mapInArrow(_matcher(automaton, name, text, False), T.StructType([*docs.schema.fields, T.StructField(name, FOUND)]))
    return docs


def hit_words(found: str) -> Column:
    hits = F.zip_with(F.col(found)["starts"], F.col(found)["ends"], lambda s, e: (e - s).cast("bigint"))
    return F.aggregate(hits, F.lit(0).cast("bigint"), lambda total, n: total + n)


def is_contaminated(found: str, share: int = 20) -> Column:
    """At least one word hit, and one word in ``share``."""
    hit = hit_words(found)
    return (hit > 0) & (hit * share >= F.col(found)["n_words"])


def longest_hit(found: str) -> Column:
    spans = F.zip_with(F.col(found)["starts"], F.col(found)["ends"], lambda s, e: e - s)
    return F.coalesce(F.array_max(spans), F.lit(0))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """The documents, all columns unchanged, without those of which one word in ``share`` or more is hit."""
    (name,) = fresh(docs, "_found")
    return find_items(docs, benchmark, name, **options).filter(~is_contaminated(name, share)).drop(name)


def remove_hits(docs: DataFrame, benchmark: DataFrame, longest: int = WINDOW, text: str = "text", **options) -> DataFrame:
    """The documents with their hit runs of ``longest`` words or more cut out of the text, the rest of it as it was."""
    (name,) = fresh(docs, "_found")
    found = find_items(docs, benchmark, name, text=text, **options)
    schema = found.schema

    def cut(content: bytes | None, starts: list[int], ends: list[int]) -> str | None:
        spans = [(s, e) for s, e in zip(starts, ends) if e - s >= longest]
        if content is None or not spans:
            return None if content is None else content.decode()
        plain = np.frombuffer(content, np.uint8)
        word = (plain >= 128) | ((plain >= 48) & (plain <= 57)) | ((plain | 32) >= 97) & ((plain | 32) <= 122)
        edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep, at = [], 0
        for s, e in spans:
            keep.append(content[at : first[s]])
            at = last[e - 1]
        return b"".join([*keep, content[at:]]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(name).to_pylist()
            texts = [cut(t, f["starts"], f["ends"]) for t, f in zip(byte_texts(batch, text), found)]
            at = batch.schema.get_field_index(text)
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return found.mapInArrow(run, schema).drop(name)
