"""Views of plain tables as messages, a change feed and scored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a folder of this machine if Spark runs on it alone."""
    import tempfile

    set_to = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        set_to = f"file://{tempfile.mkdtemp(prefix='lantern-')}"
        spark.conf.set("spark.checkpoint.dir", set_to)
    return set_to.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: lineage ends here, and executors may be lost after it."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


#: Tables of whole texts, and the rows of one that Python is handed at once; Spark's 10,000 would put 10,000 texts into each worker.
TEXTS, ARROW_ROWS = ("documents", "pages", "conversations"), 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TEXTS and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as threaded messages: message_id, thread_id, position, sender, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("position"), F.col("role").alias("sender"), "text")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change feed: history_id, ts_us (epoch microseconds, UTC), thread_id, event_type, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("history_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("user_id").alias("thread_id"), "event_type", "value", "props")
