"""Session helpers: the shared folder that checkpoints go to, and written tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one of this machine only where none is named and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders of the tables that written() made and discard() hasn't deleted, by the table's number.
_FOLDERS: dict[int, str] = {}


def written(df: DataFrame, label: str, options: dict | None = None) -> DataFrame:
    """df, written to the shared folder as Parquet (with these options) and read again: recovery from a lost executor restarts here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _FOLDERS[id(out)] = path
    weakref.finalize(out, _FOLDERS.pop, id(out), None)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that written() made and nothing needs any more."""
    if folder := _FOLDERS.pop(id(df), None):
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of whole texts in one batch between Spark and Python: a few megabytes, of which either side holds several copies.
BATCH_ROWS = 1000


def text_batches(df: DataFrame) -> DataFrame:
    """df; its session sends smaller batches to Python from now on, as rows are whole texts. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(df.sparkSession.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        df.sparkSession.conf.set(key, BATCH_ROWS)
    return df


#: Rows of one task where a row costs much more to work on than to read, or goes to a file that one task reads.
SPREAD_ROWS = 20_000


def spread(df: DataFrame, rows: int = SPREAD_ROWS) -> DataFrame:
    """df, dealt evenly to tasks of about so many rows: a table of small rows is a few splits of a file only. Counts the rows first."""
    return df.repartition(max(1, -(-df.count() // rows)))
