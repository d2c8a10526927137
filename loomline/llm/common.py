"""What the operators of this subpackage share: tables, checkpoints and byte arithmetic.

The byte arithmetic works on whole Arrow batches: texts are taken as one UTF-8 buffer and
words, windows and their hashes are found with numpy, never character by character.
"""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- tables and lineage -----------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where it is unset a local session, whose executor is the driver, uses a folder of this process;
    on a cluster that is an error.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
    return os.path.join(tempfile.gettempdir(), f"loomline-{os.getpid()}")


FILE_ROWS = 20_000


class Scratch:
    """Tables in the shared folder, which are dropped as soon as they aren't needed."""

    every: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.at = spark, f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.paths: dict[str, DataFrame] = {}
        self.every.append((spark, self.at))

    def table(self, name: str, df: DataFrame, most: int | None = None) -> DataFrame:
        """The rows of df, written and read again: this cuts the lineage, and outlives executors.

        Where there are at most `most` rows, no more files are written than rows of `FILE_ROWS` need.
        """
        df = df if most is None else df.coalesce(most // FILE_ROWS + 1)
        path = f"{self.at}/{len(self.paths)}-{uuid.uuid4().hex[:8]}-{name}"
        df.write.parquet(path)
        self.paths[path] = self.spark.read.schema(df.schema).parquet(path)
        return self.paths[path]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables, and lets Spark delete the shuffle files that nothing refers to."""
        for path in [p for p, t in self.paths.items() if any(t is x for x in tables)]:
            delete(self.spark, path)
            del self.paths[path]
        self.spark.sparkContext._jvm.System.gc()

    def drop_all_but(self, *kept: DataFrame) -> None:
        self.drop(*(t for t in list(self.paths.values()) if not any(t is k for k in kept)))


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder and read again. They stay until `sweep`."""
    return Scratch(df.sparkSession).table("cut", df)


def sweep(spark: SparkSession) -> None:
    """Deletes what this process has written to the shared folder; no DataFrame made before may be used after it."""
    for of, at in [x for x in Scratch.every if x[0] is spark]:
        delete(of, at)
    Scratch.every[:] = [x for x in Scratch.every if x[0] is not spark]


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def trimmed(of):
    """A map over Arrow batches that gives freed memory back to the system at its end; workers live on between tasks."""

    @functools.wraps(of)
    def run(batches):
        try:
            yield from of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for columns that a table with these columns lacks, whatever their case."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def fold_of(doc_id: str, folds: int):
    """crc32 of the decimal doc_id, modulo folds; a null doc_id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """df, whose session from now on sends at most `BATCH_BYTES` to Python at a time, or one row, unless it has a bound of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


# --- byte buffers -----------------------------------------------------------------------

CHUNK_BYTES = 1 << 19

#: The ASCII white space that parts words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64


def buffers(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about `limit` bytes: (first row, end row, bytes, offsets).

    offsets has a bound more than there are rows. A null text is an empty one. A text longer
    than the limit comes alone and whole.
    """
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if n == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least. base is odd."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        up = np.full(size, base, U)
        down = np.full(size, pow(base, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Odd multipliers of the rolling hashes: two independent ones for bytes and for words.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of any slices of a sequence, from its prefix sums."""

    def __init__(self, values: np.ndarray, base: int) -> None:
        up, self.down = powers(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values.astype(U) * up[: len(values)], dtype=U, out=self.sums[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the slices [start, end); mix() them before use."""
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, length: int) -> np.ndarray:
        """Hashes of every window of that length."""
        n = len(self.sums) - length
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, U)


def words(buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each text, and for each text its bounds among them."""
    inside = ~space[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[off] = True
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(buf):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
    starts = np.flatnonzero(inside & (~before | first[:-1]))
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    h = Rolling(buf.astype(U) + U(1), base).slices(starts, ends)
    return mix(h + (ends - starts).astype(U))


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from zero and values of a list column without nulls."""
    return np.asarray(col.offsets).astype(np.int64) - col.offsets[0].as_py(), np.asarray(col.flatten())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out
