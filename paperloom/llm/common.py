"""Shared building blocks of the training-data operators.

Text is handled as UTF-8 bytes taken straight from Arrow buffers, many
documents at a time, so that word splitting and hashing are numpy operations
over a whole slice of documents instead of a Python loop over words.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of the word class ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Bytes of text that one numpy step handles; a longer document is one step of its own.
SLICE_BYTES = 2 << 20

_MASK = (1 << 64) - 1


# --------------------------------------------------------------------- tables


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a
    temporary folder is set only where a local session names none (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with files every executor can read, so a lost
    executor costs a re-read and never a recomputation with other row ids.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_bucketed(df: DataFrame, name: str, by: str) -> DataFrame:
    """As ``materialize``, dealt into buckets by a column: a join on that column
    moves its other side only. The catalogue's entry goes at once; the files stay.
    There are as many buckets as the input or a shuffle has partitions."""
    spark = df.sparkSession
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions()), 100_000)
    table = f"paperloom_{name}_{uuid.uuid4().hex}"
    path = f"{scratch_dir(spark)}/paperloom/{name}-{uuid.uuid4().hex}"
    df.repartition(n, by).write.bucketBy(n, by).option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialised tables that nothing needs any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` columns by position, so that other columns, whatever
    their names (other case, repeated, dotted), cannot make a name ambiguous.
    The first column of exactly that name counts."""
    names = df.columns
    flat = df.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.select(*[F.col(f"_{names.index(old)}").alias(new) for new, old in columns.items()])


def fold_of(doc_id: str) -> F.Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


# ----------------------------------------------------------------- text bytes


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "")
    return col


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array without nulls, and n + 1 offsets into them."""
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of documents of about ``limit`` bytes of text."""
    col = text_column(batch, name)
    data, offs = text_bytes(col)
    at = 0
    while at < len(col):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def spans(keep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``keep`` bytes that do not cross documents: starts,
    ends, and for each document the index of its first run (n + 1 values)."""
    n = len(keep)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = np.zeros(n + 1, dtype=bool)
    first[offs] = True
    starts = keep.copy()
    starts[1:] &= ~keep[:-1] | first[1:-1]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:] | first[1:-1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each document, as for ``spans``."""
    return spans(~SPACE[data], offs)


# -------------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Polynomial hashes modulo 2^64 of ranges, by prefix sums."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(m, b & _MASK, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], dtype=np.uint64, out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((prefix[e] - prefix[s]) * self.down[s])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of each run of k values."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTES = Rolling(0x9E3779B97F4A7C13)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, limit: int = SLICE_BYTES) -> np.ndarray:
    """64-bit hash of each byte range; ranges are sorted and do not overlap.
    Long inputs are handled ``limit`` bytes at a time."""
    out = np.empty(len(s), np.uint64)
    at = 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + limit, "right")))
        lo = s[at]
        p = _BYTES.prefix(_TABLE[data[lo : e[to - 1]]])
        out[at:to] = _BYTES.ranges(p, s[at:to] - lo, e[at:to] - lo) + (e[at:to] - s[at:to]).astype(np.uint64)
        at = to
    return out


def doc_of(begins: np.ndarray) -> np.ndarray:
    """Document index of each item, from the first item of each document."""
    return np.repeat(np.arange(len(begins) - 1), np.diff(begins))


def sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each document."""
    c = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=c[1:])
    return c[begins[1:]] - c[begins[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (n + 1 values)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
