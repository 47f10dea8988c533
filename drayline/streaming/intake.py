"""Line files arriving in a folder, parsed as they come; valid rows and rejects go to two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from drayline.operators.parse_rows import parse_rows


def stream_intake(spark: SparkSession, folder: str, files: DataFrame, columns: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Parse Parquet files of raw lines that appear in ``folder``; everything there is read, then the query ends.

    Each micro-batch is written by its number, so a batch that is repeated after a failure replaces its own rows.
    """
    lines = spark.readStream.schema("source_file_id string, line_no long, line string").parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        parsed = parse_rows(batch, files, columns).persist()
        parsed.where("error is null").drop("error").write.mode("overwrite").parquet(f"{out}/valid/batch={number}")
        parsed.where("error is not null").drop("values").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        parsed.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
