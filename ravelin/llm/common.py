"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of the text operators: runs of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session has none and runs on one machine (tests), a temporary
    folder is set and remembered for the session; on a cluster that would lose
    rows, so it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.ravelin.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.ravelin.shared.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables that cut() has written in this process.
_WRITTEN: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: lineage ends
    here, and losing an executor costs no more than the stage under way. The table
    stays until clean()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ravelin-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables that cut() has written, for when the results are stored;
    returns their number. Works on any store that Spark reaches."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def checkpoint(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder; for small tables in loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names made of the given ones that no column of df has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = f"__{name}"
        while new.lower() in taken:
            new = f"_{new}"
        taken.add(new.lower())
        out.append(new)
    return out


def release() -> None:
    """Gives memory that this process has freed back to the system, as far as its
    allocators can: Python workers live on from task to task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim:
        trim(0)


#: Rows in an Arrow batch of texts: a few megabytes on either side.
TEXTS_AT_ONCE = 500


def short_batches(spark: SparkSession) -> None:
    """Lowers the session's rows in an Arrow batch: texts are long, and batches of
    the usual length hold tens of megabytes in JVM and worker several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > TEXTS_AT_ONCE:
        spark.conf.set(key, str(TEXTS_AT_ONCE))


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves no rest on division by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def no_rows(df: DataFrame) -> bool:
    """Whether df is empty; reads one row at most."""
    return df.limit(1).count() == 0
