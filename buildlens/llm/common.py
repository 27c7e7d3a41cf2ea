"""Helpers that the operators share: where intermediate tables go, and how texts are cut into words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a folder of this machine serves local mode only.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="buildlens-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again, which cuts its lineage."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what ``materialize`` wrote, once all that was read from it has been written itself."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            session = df.sparkSession
            target = session._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def doc_key() -> Column:
    """128 bits of a row's doc_id and text. Rows of one doc_id and text share a key; a null counts as empty."""
    return F.unhex(F.md5(F.concat_ws("\0", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))))


#: Rows of a batch that goes to Python where each row is worked on by itself; ten thousand long texts at once fill a task's memory.
BATCH_ROWS = 2000


def by_small_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in batches of BATCH_ROWS at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def is_held_out(doc_id, divisor: int, remainder: int):
    """crc32 of doc_id as text has the remainder; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor == remainder


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def pieces_of(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of texts by about so many bytes each; a longer text is a slice of its own."""
    texts = texts.fill_null("")
    ends = np.cumsum(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield at, texts.slice(at, end - at)
        at = end


def end_to_end(parts: pa.LargeBinaryArray, rows: np.ndarray) -> pa.LargeBinaryArray:
    """Joins neighbours: row i is of the parts from rows[i] to rows[i + 1]."""
    ends = np.frombuffer(parts.buffers()[1], np.int64) if len(parts) else np.zeros(1, np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[rows])), parts.buffers()[2] or pa.py_buffer(b"")])


class DistinctWords:
    """Words of a slice of texts, where each distinct one is looked at once: ``words``, and ``at``, the place of every
    occurrence's word among them. ``rows`` has the first occurrence of each text, and their number at last."""

    def __init__(self, lists: pa.ListArray):
        coded = lists.flatten().dictionary_encode()
        self.words, self.at = coded.dictionary, coded.indices
        self.rows = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Per text, of a number for each distinct word."""
        total = np.r_[values.dtype.type(0), np.cumsum(values[self.at.to_numpy()])]
        return total[self.rows[1:]] - total[self.rows[:-1]]

    def joined(self, spelled: pa.LargeBinaryArray) -> list[memoryview]:
        """Per text, what stands for its words, end to end."""
        out = end_to_end(spelled.take(self.at), self.rows)
        data, ends = memoryview(out.buffers()[2]), np.frombuffer(out.buffers()[1], np.int64).tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:])]
