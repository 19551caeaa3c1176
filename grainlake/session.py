"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: list[str] = []
_WRITTEN: list[str] = []


def build_session(master: str = "local[8]", app: str = "grainlake", **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the caller's session is used as it is."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, local mode) a temporary folder is made and removed at exit.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append(tempfile.mkdtemp(prefix="grainlake-"))
        atexit.register(shutil.rmtree, _OWN_SCRATCH[0], ignore_errors=True)
    return "file://" + _OWN_SCRATCH[0]


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write df to the shared scratch folder and read it again.

    Cuts the lineage with files that survive the loss of an executor, and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/grainlake/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.is_written = True
    return written


def shared_files(df: DataFrame, tag: str = "step") -> list[str]:
    """The files of a materialized frame; another one is materialized first."""
    return sorted((df if getattr(df, "is_written", False) else materialize(df, tag)).inputFiles())


def shared_batches(files: list[str], rows: int = 10_000, columns: list[str] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of materialized files, read within a task in batches of at most `rows`."""
    for file in files:
        where, path = fs.FileSystem.from_uri(file)
        with where.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=rows, columns=columns)


def release_all(spark: SparkSession) -> None:
    """Delete every frame materialized so far in this process; call it when no result that reads them is wanted any more."""
    jvm = spark.sparkContext._jvm
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
