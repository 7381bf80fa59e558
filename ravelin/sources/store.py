"""Tables that the engine writes on its way, in the folder that all machines share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that cut() has written in this process.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a session on one machine
    (tests) gets a temporary folder and keeps it; a cluster would lose rows, so it
    raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.ravelin.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ravelin-")
        spark.conf.set("spark.ravelin.shared.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df, written once as Parquet and read back: its lineage ends here, and what is
    made from it twice is made from the same rows. The table stays until clean()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ravelin-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes a table or file of any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True))


def mark() -> int:
    """Where the list of tables that cut() has written stands now."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int, *keep: DataFrame) -> int:
    """Removes the tables written since a mark() but those that `keep` read; returns
    their number. For operators that write tables in a loop."""
    kept = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for df in keep for f in df.inputFiles()}
    going = [p for p in _WRITTEN[since:] if p.rsplit("/", 1)[-1] not in kept]
    for path in going:
        _WRITTEN.remove(path)
        remove(spark, path)
    return len(going)


def clean(spark: SparkSession) -> int:
    """Removes the tables that cut() has written, for when the results are stored;
    returns their number."""
    n = 0
    while _WRITTEN:
        n += remove(spark, _WRITTEN.pop())
    return n


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder of any store that Spark reaches is there."""
    at, fs = _store(spark, path)
    return bool(fs.exists(at))


def put_json(spark: SparkSession, path: str, record: dict) -> None:
    """Writes a small record: under another name first, so that it is whole or not there."""
    at, fs = _store(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(new, at):
        raise OSError(f"{path} can't be written")


def get_json(spark: SparkSession, path: str) -> dict | None:
    """A record that put_json() wrote, None if it isn't there."""
    if not there(spark, path):
        return None
    return json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))  # one small file


class Stale(RuntimeError):
    """An output is there that was made from something else."""


def write_made(df: DataFrame, path: str, made_from: dict, force: bool = False) -> bool:
    """Writes df to path as Parquet with the record of what it is made from, unless the
    same is there already; returns whether it wrote. Raises Stale if an output is there
    that was made from something else, or without a record, and force is not given. A
    broken-off write leaves no record and so never counts as made."""
    spark, record = df.sparkSession, f"{path}.made.json"
    found = get_json(spark, record)
    if found == made_from and there(spark, path) and not force:
        return False
    if there(spark, path) and not force:
        differs = sorted(k for k in {*made_from, *(found or {})} if (found or {}).get(k) != made_from.get(k))
        raise Stale(f"{path.rsplit('/', 1)[-1]} was made from something else ({', '.join(differs) or 'unknown'}); remove it or force")
    if found is not None:
        remove(spark, record)
    df.write.mode("overwrite").parquet(path)
    put_json(spark, record, made_from)
    return True
