"""Scoring of a stream of texts with a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions.text import prediction_text
from ..plans.pipeline import TextModel
from ..session import drop_shared, write_shared
from ..sources.writers import prediction_lines


def read_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(text) of a stream of text files as they appear: lines of plain text or JSON objects; blank lines are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return lines.where(F.col("value").rlike(r"\S")).select(prediction_text(F.col("value")).alias("text"))


def score_stream(lines: DataFrame, model: TextModel, output: str, checkpoint: str) -> StreamingQuery:
    """Writes predictions as JSON lines, a folder a batch; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        # ids must be the same wherever a text is read in the plan, so they come from the text, not from its place
        numbered = batch.groupBy("text").agg(F.count("*").alias("copies")).withColumn("doc_id", F.xxhash64("text"))
        path = write_shared(numbered, "stream")
        numbered = numbered.sparkSession.read.schema(numbered.schema).parquet(path)
        found = model.predict(numbered.select("doc_id", "text")).join(numbered.select("doc_id", "copies"), "doc_id")
        every = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        prediction_lines(every.select("text", "label", "probs")).write.mode("overwrite").text(f"{output}/batch={number}")
        drop_shared(numbered.sparkSession, path)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
