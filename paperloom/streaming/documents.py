"""Documents arriving as files or rows: classified and gated as they come, results upserted by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paperloom.operators import classify


def read_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def gated(documents: DataFrame) -> DataFrame:
    """Stateless: class, confidence and decision of each row."""
    return classify.extraction_gate(documents).select("doc_id", "predicted_class", "confidence", "run_extraction", "reason")


def write_results(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces its own folder, so a batch that runs again writes the same rows once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["doc_id"]).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
