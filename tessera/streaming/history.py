"""Extension: the append-only run history as a stream of JSON-lines files, with the best run of each mode kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "run_tag string, mode string, started_at string, ended_at string, accuracy double, total int, correct int, include_dataset_evidence boolean"


def history_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of new files in ``folder``; unreadable lines and lines without a run are dropped."""
    return spark.readStream.schema(SCHEMA).option("mode", "DROPMALFORMED").json(folder).where("run_tag is not null")


def best_so_far(rows: DataFrame) -> DataFrame:
    """(mode, accuracy, run_tag, runs): a running aggregate, the same in a stream as in a batch; of equals the earlier end wins."""
    rank = F.struct(F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), (-F.coalesce(F.unix_timestamp(F.try_to_timestamp("ended_at")), F.lit(0))).alias("age"), "run_tag")
    g = rows.groupBy(F.coalesce("mode", F.lit("unknown")).alias("mode")).agg(F.max(rank).alias("b"), F.count("*").alias("runs"))
    return g.select("mode", F.col("b.accuracy").alias("accuracy"), F.col("b.run_tag").alias("run_tag"), "runs")


def keep_best(rows: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keeps the table ``name`` in memory complete with every micro-batch."""
    return best_so_far(rows).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
