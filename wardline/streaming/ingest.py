"""Incremental ingest of documents as a stream, and windowed queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.functions import text as X
from wardline.streaming import state


def prepared(docs: DataFrame, least_quality: float = 0.3, least_words: int = 20) -> DataFrame:
    """Documents (doc_id, source, content) cleaned, hashed and scored; poor and short ones go."""
    out = docs.withColumn("content", X.clean_text(F.coalesce("content", F.lit("")))).withColumn("hash", X.content_hash(F.col("content"))).withColumn("quality", X.quality_score(F.col("content")))
    return out.where((F.col("quality") >= least_quality) & (F.size(F.split("content", " ")) >= least_words))


def ingest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, at: str | None = None, ttl_seconds: int | None = None, late: str = "1 day"):
    """Reads what is new in a folder of JSON documents and adds the changes to `target`; returns the ended query.

    `at` names the column with a delivery's time; without it a file's modification time counts. The state
    is the stream's own, one hash a document, so a micro-batch costs what it has, and the history is not
    read. Each micro-batch overwrites its own partition: one that runs again after a failure changes nothing.
    """
    docs = spark.readStream.schema(schema).json(folder)
    stamped = docs.withColumn("at", F.col(at).cast("timestamp") if at else F.col("_metadata.file_modification_time"))
    changes = state.track(prepared(stamped), late=late, ttl_seconds=ttl_seconds)

    def step(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={epoch}")

    with state.keyed_store(spark):
        query = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def current(spark: SparkSession, target: str, few: int = 1_000_000) -> DataFrame:
    """The last form of every document that has not expired.

    Only what was replaced is looked up, by document and version: up to `few` of them (some 30 bytes each)
    are broadcast, and contents are not shuffled; beyond that it is a join of both.
    """
    rows = spark.read.parquet(target)
    gone = rows.where("replaces is not null").select("doc_id", F.col("replaces").alias("version"))
    gone = F.broadcast(gone) if gone.count() <= few else gone
    return rows.where("change <> 'expired'").join(gone, ["doc_id", "version"], "left_anti")


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of events (ts, event_type, value) in tumbling or sliding windows; works on streams too."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", length, slide or length).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with less than `gap` between them."""
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def streamed_counts(spark: SparkSession, folder: str, pattern: str, schema, name: str, checkpoint: str) -> DataFrame:
    """Counts by type from a stream over a folder's Parquet files that is read to its present end, in complete mode."""
    events = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    query = events.groupBy("event_type").count().writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def asof(left: DataFrame, right: DataFrame, on: str, at: str, value: str, seconds: int = 86400) -> DataFrame:
    """`left` with the `value` of the last right row of its key at or before its time; null if none.

    Rows of a key are dealt by stretches of time of `seconds`; what the last earlier stretch ended with
    is carried over from one row a stretch, so a hot key is spread over many tasks.
    """
    part = F.floor(F.unix_seconds(F.col(at)) / seconds)
    stamped = right.select(on, at, value, part.alias("__part"))
    ends = stamped.groupBy(on, "__part").agg(F.max_by(value, at).alias("__end"))
    rows = left.select(*left.columns, part.alias("__part"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias(value)).unionByName(
        stamped.withColumn("__side", F.lit(0)), allowMissingColumns=True)
    parts = rows.select(on, "__part").distinct().join(ends, [on, "__part"], "left")
    over = Window.partitionBy(on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(on, "__part", F.last("__end", True).over(over).alias("__carried"))
    inside = Window.partitionBy(on, "__part").orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn(value, F.last(value, True).over(inside)).where("__side = 1").join(carried, [on, "__part"])
    return found.withColumn(value, F.coalesce(value, "__carried")).select(*left.columns, value)


def in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Points joined to the ranges [low, high) that hold them, by an equality join on cells of `width`."""
    cell = lambda c: F.floor(c / width)
    spread = ranges.where(F.col(low) < F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    return points.withColumn("__cell", cell(F.col(at))).join(spread, "__cell").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__cell")
