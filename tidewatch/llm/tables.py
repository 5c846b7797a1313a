"""Small shared helpers: reading inputs, cutting lineage in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Unset, a local session (tests) gets a temporary one; a cluster has no folder that would do."""
    found = spark.conf.get(SETTING, None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


#: Rows that a file of a written table stands for at least, beyond FEW_FILES files.
FILE_ROWS, FEW_FILES = 20_000, 12


def files_for(rows: int) -> int:
    """How many files a table of about so many short rows may have: without native Hadoop code, each file that a task opens starts processes, whose memory the system counts as that of the executor over again until they run."""
    return max(FEW_FILES, -(-rows // FILE_ROWS))


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a table in the shared folder, of so many files at most: its lineage ends there, so a lost executor costs no recomputation."""
    df = df if files is None else df.coalesce(files)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that `written` made, once nothing reads them any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names for internal use that clash with no column of df, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def hash_share(of: Column, wanted: int, there: int) -> Column:
    """Whether a row is in the share of about `wanted` of `there` rows with the least hashes: bounded samples that a rerun draws alike, without a sort."""
    if there <= wanted:
        return F.lit(True)
    edge = -(1 << 63) + (1 << 64) * wanted // there
    return F.xxhash64(of) <= F.lit(edge).cast("long")


#: Rows, or what stands for them, up to which a side is broadcast.
MOST_SENT = 500_000


def hash_side(df: DataFrame, cells: Column | None = None, most: int = MOST_SENT, n: int | None = None) -> DataFrame:
    """A written table as the hash side of a join with a far larger one: broadcast if its rows `n`, or the sum of `cells`, are at most `most`, which is counted first; else dealt by hash beside it, so that the larger side isn't sorted."""
    if n is None:
        n = df.agg(F.sum(cells)).first()[0] if cells is not None else df.count()
    return F.broadcast(df) if (n or 0) <= most else df.hint("shuffle_hash")


#: Rows of an Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS = 1000


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow in small batches, whose workers give memory back when a task ends; they are reused, and would else keep what the largest task of any job took."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return df.mapInArrow(lean, schema)
