"""Session construction and the shared-folder helpers every operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Session settings that the library's semantics rely on.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}


def build_session(app: str = "siltstone", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster the session is given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    The cluster names a folder that all executors share in ``spark.checkpoint.dir``; it is read
    from the session. Where it is unset a local session gets one of its own; on a cluster, where
    a folder of this machine would be seen by this machine only, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return context._jsc.sc().getCheckpointDir().get()
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "siltstone-checkpoints")
    context.setCheckpointDir(named)
    return named


#: Intermediate folders of this process that are not deleted yet, and tables over them.
_MADE: dict[str, str | None] = {}


def scratch(spark: SparkSession, kind: str, table_name: str | None = None) -> str:
    """A new path in the shared folder, deleted by ``release`` or when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    _MADE[path] = table_name
    return path


def release(spark: SparkSession) -> int:
    """Delete the intermediate folders and tables made so far; data frames that read them must be done with."""
    jvm, n = spark.sparkContext._jvm, 0
    while _MADE:
        path, name = _MADE.popitem()
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        n += 1
    return n


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage is cut, columns stay prunable."""
    path = scratch(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, found without counting further."""
    return df.limit(max_rows + 1).count() <= max_rows


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of the session's storage."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
