"""Session defaults and durable cut points for iterative plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app_name: str = "tracewarden", **conf: str) -> SparkSession:
    """A session with the defaults this library is tuned for; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a private one only on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = getattr(context, "_tracewarden_scratch", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="tracewarden-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._tracewarden_scratch = folder
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Delete tables made by ``materialize`` that nothing reads any more; other tables stay."""
    for df in tables:
        path = getattr(df, "scratch_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def brief(error: Exception) -> str:
    """The one line of an error that says what happened, also when it crossed from a worker."""
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    raised = [line for line in lines if line.split(":", 1)[0].endswith(("Error", "Exception")) and ": " in line]
    return (raised or lines or [type(error).__name__])[-1 if raised else 0]


def side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each, as one table of one row."""
    values: list = []
    schema = T.StructType()
    for df in rows:
        values += list(df.first())
        for field in df.schema.fields:
            schema = schema.add(field.name, field.dataType, True)
    return rows[0].sparkSession.createDataFrame([tuple(values)], schema)


def spread(df: DataFrame) -> DataFrame:
    """At least one partition per core, for Python work that costs far more than moving its rows.

    Meant for a plain scan: a large table already has more partitions and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
