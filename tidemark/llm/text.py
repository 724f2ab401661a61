"""Words, hashes and small frame helpers shared by the text operators.

Texts reach Python as UTF-8 bytes: byte methods lower-case A-Z only and split in C.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

# Bytes that are neither 0-9, a-z, A-Z nor above 127 become a space; A-Z become a-z.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
CACHED_WORDS = 150_000
FILTER_BITS = 23  # bits of the filter by hash that is sent to the tasks: 1 MB, whatever the input


def alnum_words(text: bytes | None) -> list[bytes]:
    """Runs of 0-9, a-z and anything above ASCII, A-Z lower-cased."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Runs of anything but the space and the characters 9 to 13, A-Z lower-cased."""
    return text.lower().split() if text else []


class WordHash(dict):
    """Word to 64-bit hash; the cache is dropped whenever it is full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mixed(hashes[:n] + np.uint64(size))
    for i in range(1, size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    return batch.column(name).cast(pa.large_binary()).to_pylist()


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that the frame does not have yet, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    names = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] = ()) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def id_filter(rows: DataFrame, name: str) -> bytes:
    """A bit for each hash of a column: rows without their bit need not be shuffled, the others are joined."""
    bit = F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))
    words = rows.groupBy((bit / 32768).cast("int").alias("word")).agg(F.bitmap_construct_agg((bit % 32768).cast("bigint")).alias("bits"))
    out = bytearray(1 << (FILTER_BITS - 3))
    for word, bits in words.collect():  # at most 2**FILTER_BITS / 32768 rows of 4 KB
        out[word * 4096 : word * 4096 + 4096] = bits
    return bytes(out)


def passing(docs: DataFrame, name: str, bits: bytes) -> DataFrame:
    """The rows whose column has its bit: all that were asked for, and few others."""
    names, (bit,) = docs.columns, fresh(docs, "_bit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(bits, np.uint8)
        for batch in batches:
            at = batch.column(bit).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array((table[at >> 3] >> (at & 7)) & 1 == 1)).select(names)

    return docs.withColumn(bit, F.pmod(F.xxhash64(name), F.lit(1 << FILTER_BITS))).mapInArrow(run, docs.schema)
