"""Structured Streaming into a database: every micro-batch is one write.

Duplicates are resolved where tables are read, so ingest keeps no state and needs no watermark: a batch that is run again
after a failure writes the same points once more, which changes nothing. Lines that do not parse go to the ``rejected``
folder with their reasons, and the others of the batch are written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.lifecycle.policy import maintain
from tidemark.operators import quarantine
from tidemark.session import cut_lineage, scratch_path
from tidemark.store.database import Db


def lines_from_folder(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """Line protocol files as they arrive in a folder; a file is one text, as values may hold line breaks."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)


def lines_from_kafka(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Messages of a topic as line protocol texts; needs Spark's Kafka package on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return reader.options(**options).load().select(F.col("value").cast("string").alias("value"))


def to_kafka(lines: DataFrame, servers: str, topic: str, checkpoint: str) -> StreamingQuery:
    """Forward a stream of line protocol texts to a topic, for other databases to read."""
    out = lines.select(F.col(f"`{lines.columns[0]}`").cast("binary").alias("value")).writeStream.format("kafka")
    return out.option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def write_batch(db: Db, text: str = "value", rejected: str | None = None, maintenance: bool = False) -> Callable[[DataFrame, int], None]:
    """What is done with one micro-batch."""

    def run(batch: DataFrame, number: int) -> None:
        parsed = cut_lineage(quarantine.parse_lines(batch.select(F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("_text")), "text"))
        valid, bad = quarantine.split_valid(parsed)
        if rejected is not None:
            bad.select(F.lit(number).cast("bigint").alias("batch"), "line_no", "body", "errors").write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        points = quarantine.typed_rows(valid, F.lit(int(db.now() * 1e9)).cast("bigint")).withColumn("_order", F.struct("_text", "line_no"))
        if not points.isEmpty():
            db.write_points(points)
        if maintenance:
            maintain(db)

    return run


def ingest(lines: DataFrame, db: Db, checkpoint: str | None = None, rejected: str | None = None, once: bool = True, maintenance: bool = False) -> StreamingQuery:
    """Start writing a stream of texts (its first column) to a database; ``once`` takes what there is and ends."""
    place = checkpoint or scratch_path(db.spark, "ingest")
    writer = lines.writeStream.foreachBatch(write_batch(db, lines.columns[0], rejected, maintenance)).option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if once else writer).start()
