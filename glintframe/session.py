"""Session defaults and lineage cuts."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def build_session(app: str = "glintframe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_code(builder.getOrCreate())


def ship_code(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once for each Spark application; they need not have it installed."""
    context = spark.sparkContext
    if not getattr(context, "_glintframe_sent", False):
        package = pathlib.Path(__file__).resolve().parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="spark-")) / "glintframe-code.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        context._glintframe_sent = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for cut tables: the cluster's ``spark.checkpoint.dir``, or a scratch one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    scratch = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", scratch)
    return scratch


def place(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-place rows by key on the configured number of shuffle partitions.

    For stages whose cost per byte is high (line windows, Python groups): adaptive
    coalescing, which looks at bytes only, would leave them to a few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    One execution of the plan, columnar on disk, and it outlives any executor; the
    re-read table carries real sizes, so adaptive execution can choose join sides.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
