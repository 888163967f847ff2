"""Session construction and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def lake_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators were tuned for.

    Broadcast decisions are left to Spark: the threshold is compared with the measured size of the
    side, so a table that outgrows it moves to a shuffled join by itself, and skewed partitions of
    that join are split by AQE.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
        "spark.ui.enabled": "false",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark cut Arrow batches by bytes, so that 10,000 rows of long values do not pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _shared_base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="lakeops-")
        spark.conf.set("lakeops.scratch.dir", base)
        return base
    raise RuntimeError("spark.checkpoint.dir must name a folder shared by the driver and the executors")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder of the machine.
    """
    base = spark.conf.get("lakeops.scratch.dir", None) or _shared_base(spark)
    return f"{base}/lakeops/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:10]}"


def durable(df: DataFrame) -> DataFrame:
    """Materialize ``df`` as a table on shared storage, so that everything downstream sees one
    evaluation of it and a lost executor costs a read instead of a recomputation.

    Unlike a checkpoint of rows, the table can be pruned to the columns each reader needs.
    """
    path = scratch_dir(df.sparkSession, "durable")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a ``durable`` table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lakeops/" in folder and folder.rsplit("/", 1)[1].startswith("durable-"):
            handle = jvm.org.apache.hadoop.fs.Path(folder)
            handle.getFileSystem(conf).delete(handle, True)
