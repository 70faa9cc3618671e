"""Helpers shared by the corpus operators: shipping code, shared scratch tables, text buffers.

Conventions that hold for every operator here:

* a null text counts as empty, a null id stays null and its row is kept;
* rows are never merged: a row that occurs twice comes out twice;
* only the named id and text columns are read, so other columns, whatever
  their names, cannot clash with an operator's results;
* an empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.session import ship_code

#: Rows and bytes in an Arrow batch sent to a Python worker, at most; a longer text is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20
PLAIN_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN_WORD_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_words(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return PLAIN_WORD.findall(text.encode("utf-8").lower()) if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of ``plain_words`` stand, in code points."""
    return [m.span() for m in PLAIN_WORD_TEXT.finditer(text)]


def prepare(spark: SparkSession) -> SparkSession:
    """Make the package importable on the executors and keep Arrow batches small."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: A block of this size goes back to the system as soon as it is freed (glibc else raises the limit to 32 MB).
MAPPED_BYTES = 1 << 20
_M_MMAP_THRESHOLD = -3
_KEPT: dict[str, dict] = {}


@lru_cache(None)
def _allocator():
    """The C library's allocator, told once for a worker to map large blocks; none for another C library."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(_M_MMAP_THRESHOLD, MAPPED_BYTES)
        return libc
    except (OSError, AttributeError):
        return None


def give_back() -> None:
    """Return what was freed to the system, so that the next task starts small."""
    pa.default_memory_pool().release_unused()
    if (libc := _allocator()) is not None:
        libc.malloc_trim(0)


def kept(owner: str) -> dict:
    """What a Python worker keeps for ``owner`` from task to task; what it kept for others is let go.

    Called at the start of a task; memory that earlier tasks freed goes back to the system.
    """
    others = [name for name in _KEPT if name != owner]
    for name in others:
        del _KEPT[name]
    if others:
        gc.collect()
    give_back()
    return _KEPT.setdefault(owner, {})


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Another number of rows in an Arrow batch, for tables of few large or many small rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(BATCH_ROWS))


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Another value of a setting for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for a local master without a setting."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="retentio-shared-")
        sc.setCheckpointDir(folder)
    return folder


class Scratch:
    """Tables written to the shared folder, so that no later step depends on an executor's disk."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/retentio-{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}

    def store(self, df: DataFrame, name: str, **options) -> DataFrame:
        """Write ``df`` (with the writer's ``options``) and read it again; the plan so far is cut here."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(**options).parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete stored tables that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each begins (n + 1 offsets)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def code_points(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts end to end (uint32), and n + 1 offsets."""
    raw, _ = text_buffer(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(lengths)])


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets; empty segments give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
