"""Incremental ingest and feedback, as streams over drop folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.tables import latest_wins
from tessera.streaming.keyed import KeyedTable

#: The labels that feedback may give.
LABELS = ["Match", "Relevant", "Suggested", "Not_Relevant"]


def ingest(spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str = "doi", order: list[str] | None = None, stages: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 64) -> StreamingQuery:
    """Adds new documents of a drop folder to a `KeyedTable` under `target`; of each key the first ever wins. `ingested` reads it.

    What is there already is neither stream state, which would grow without
    end, nor found by reading the target: a batch opens only the parts of
    buckets whose filter may hold one of its keys. A batch that is run again
    after a failure adds nothing twice.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def one(batch: DataFrame, n: int) -> None:
        new = batch if stages is None else stages(batch)
        KeyedTable(batch.sparkSession, target, [key], new.schema, buckets).insert(new, n, order or [key])

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, target: str, schema, key: str = "doi") -> DataFrame:
    """The table that `ingest` keeps; `schema` is that of its rows."""
    return KeyedTable(spark, target, [key], schema).rows()


def valid_feedback(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """Feedback with a known label on a document that the logged search returned."""
    shown = log.select(F.col("id").alias("statistic_id"), F.explode(F.concat("results.relevant", "results.weakly_relevant")).alias("r")).select("statistic_id", F.col("r.doc_id").alias("doc_id")).distinct()
    return feedback.filter(F.col("feedback_type").isin(LABELS)).join(shown, ["statistic_id", "doc_id"], "left_semi")


def latest_feedback(feedback: DataFrame, keys: tuple[str, ...] = ("statistic_id", "doc_id"), order: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """One label for each key: the last one given."""
    return latest_wins(feedback, list(keys), list(order))


def upsert_feedback(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: tuple[str, ...] = ("statistic_id", "doc_id"), order: tuple[str, ...] = ("created_at",), buckets: int = 64) -> StreamingQuery:
    """Keeps a `KeyedTable` of labels under `target` up to date, one for each key: `current_feedback` reads it.

    A batch rewrites the buckets that its keys fall into and reads no others;
    one that is run again changes nothing. What is no longer current is removed.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def one(batch: DataFrame, n: int) -> None:
        KeyedTable(batch.sparkSession, target, list(keys), batch.schema, buckets).upsert(batch, n, list(order))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_feedback(spark: SparkSession, target: str, schema, keys: tuple[str, ...] = ("statistic_id", "doc_id")) -> DataFrame:
    """The label table that `upsert_feedback` keeps; `schema` is that of the feedback."""
    return KeyedTable(spark, target, list(keys), schema).rows()
