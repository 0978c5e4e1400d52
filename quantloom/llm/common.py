"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import binascii
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import bucketed, checkpoint, dropped, shared_folder, written

__all__ = ["Tokens", "bucketed", "checkpoint", "crc32", "dropped", "fold", "labelled_sample", "lower_words", "named", "pack_array", "schema", "shared_folder", "slices", "sole_memory", "table", "text_bytes", "texts", "tokens_of", "unpack_array", "with_columns", "written"]

#: Text bytes that one vectorized step works on; bounds a task's memory whatever the Arrow batch holds.
SLICE_BYTES = 4_000_000

#: White space between words: the six ASCII characters.
SPACES = b" \t\n\x0b\x0c\r"

#: ASCII upper case to lower case, and the white space above to blanks.
LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else 32 if c in SPACES else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of just that name, dots and backquotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fold(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(n)


def with_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], schema: T.StructType, keep: Iterable[str] | None = None) -> DataFrame:
    """df's columns (or `keep` of them) and those that fn derives from a batch.

    A column of df named like a derived one gives way to it. fn sees slices of about SLICE_BYTES of `text`.
    """
    new = [f.name for f in schema]
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    names, at = df.columns, [df.columns.index(c) for c in kept]
    # columns have plain names on the way, as Spark takes a dot for a field
    plain = [f"c{i}" for i in range(len(kept) + len(new))]
    kinds = [*[df.schema[i] for i in at], *schema]
    out = T.StructType([T.StructField(c, f.dataType, f.nullable) for c, f in zip(plain, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns(names)):
                made = fn(part)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in at], *[made[c] for c in new]], names=plain)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, out).toDF(*kept, *new)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about `most` bytes; a longer text comes alone."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(np.asarray(size, dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null: empty."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null: empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Maximal runs without white space, A-Z lower-cased."""
    return text.translate(LOWER_WORDS).split()


@dataclass
class Tokens:
    """The words of some texts: numbers of distinct words, text by text, an end (-1) after each."""

    distinct: list[bytes]
    number: np.ndarray  # of each token among the distinct, -1: end
    doc: np.ndarray  # of each token


def tokens_of(column: pa.Array, letters: bytes = LOWER_WORDS) -> Tokens:
    """Words of a column of texts; null: none. Cut and numbered by Arrow, on the column's bytes as `letters` maps them, blanks between words."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    column = pa.concat_arrays([column])  # offsets from 0, nothing outside the slice
    _, offsets, data = column.buffers()
    even = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(letters))
    lists = pc.split_pattern(pa.Array.from_buffers(pa.large_binary(), len(column), [None, offsets, even], offset=column.offset), " ")
    bounds = np.asarray(lists.offsets, np.int64)
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    if b"" in distinct:  # beside each other or at the ends, blanks leave empty parts
        gap = distinct.index(b"")
        keep = number != gap
        number, row = number[keep], row[keep]
        number -= number > gap
        distinct.pop(gap)
    n = np.bincount(row, minlength=len(column))
    out = np.full(len(number) + len(n), -1, np.int64)
    out[np.arange(len(number)) + row] = number
    return Tokens(distinct, out, np.repeat(np.arange(len(n)), n + 1))


_ZSTD = pa.Codec("zstd", compression_level=1)


def pack_array(x: np.ndarray) -> bytes:
    data = np.ascontiguousarray(x).tobytes()
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpack_array(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_ZSTD.decompress(x[8:], int.from_bytes(x[:8], "little"), asbytes=True), dtype)


def crc32(x: bytes) -> int:
    return binascii.crc32(x)


def schema(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in fields.items()])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """Texts and labels of at most `per_class` training rows of each class, those with the least hash of their id.

    The bound is the caller's documented parameter. Rows without a label or an id are never taken; of several labels of an id the highest
    counts, of its texts the least. Columns: doc_id, text, y.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(train).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")).withColumn("h", F.xxhash64("doc_id"))
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy("h", "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionAll(part)
    # at most 2 * per_class rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id", "y")), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


_memories: dict[str, Callable[[], None]] = {}


def sole_memory(name: str, forget: Callable[[], None]) -> None:
    """Says that an operator works in this process with what it remembers between tasks: all others forget theirs."""
    _memories[name] = forget
    for other in [k for k in _memories if k != name]:
        _memories.pop(other)()
