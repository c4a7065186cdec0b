"""Session helpers shared by tests, the bench and the command line."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast


def get_spark(app: str = "docustrata", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on: UTC and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset
    a temporary folder is made, which is right on one machine only, so this
    raises on any master that is not local.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="docustrata-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(own)
    return own


#: Rows of a configuration that is broadcast.
TOLD = 10_000


def told(table: DataFrame, most: int = TOLD) -> DataFrame:
    """A configuration, to be broadcast if it has `most` rows at most; a larger one is joined as Spark sees fit."""
    return broadcast(table) if table.limit(most + 1).count() <= most else table


_tables: dict[tuple[str, ...], str] = {}
_scratch: dict[str, SparkSession] = {}


def _sweep() -> None:
    for path, spark in list(_scratch.items()):
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone at exit; the cluster's own sweep then removes the folder
            return


atexit.register(_sweep)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/docustrata-{tag}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a path of scratch_path, when nothing will read it any more."""
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    _scratch.pop(path, None)


def materialized(spark: SparkSession, name: tuple[str, ...], made: DataFrame) -> DataFrame:
    """made, as a Parquet table in the shared folder that one application writes once for each name and removes at its end."""
    key = (spark.sparkContext.applicationId, *name)
    if key not in _tables:
        path = scratch_path(spark, name[0])
        made.write.parquet(path)
        _tables[key] = path
    return spark.read.schema(made.schema).parquet(_tables[key])
