"""Streams of run events; every function takes a batch or a streaming DataFrame unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def valid_events(events: DataFrame) -> DataFrame:
    """events with a violation where a field is missing or a value is negative."""
    rule = F.when(F.col("ts").isNull() | F.col("user_id").isNull(), "missing_field").when(~F.col("event_type").rlike("^[a-z][a-z0-9_]*$"), "bad_name").when(F.col("value") < 0, "negative_value")
    return events.withColumn("violation", rule)


def latest_status(events: DataFrame) -> DataFrame:
    """user_id, status: the type of the latest event, ties by event id."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def kind_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, event_type, n, total; a stream drops rows later than the watermark."""
    held = events.withWatermark("ts", late) if events.isStreaming else events
    got = held.groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return got.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def counters(events: DataFrame) -> DataFrame:
    """user_id, event_type, value: the latest value of each counter, ties by event id; a stream keeps one row a counter."""
    return events.groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def split_valid(events: DataFrame, fields: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """events that carry exactly the JSON fields of their type, and the others with a violation, for a dead-letter sink.

    fields: the names that props holds for each type; a type that is not listed carries none.
    """
    wanted = F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.array_sort(F.array(*map(F.lit, v))))]) if fields else None
    names = F.coalesce(F.array_sort(F.json_object_keys("props")), F.array().cast("array<string>"))
    want = F.coalesce(wanted[F.col("event_type")], F.array().cast("array<string>")) if fields else F.array().cast("array<string>")
    rule = F.when(F.size(F.array_except(want, names)) > 0, "field_missing").when(F.size(F.array_except(names, want)) > 0, "field_unknown")
    judged = valid_events(events).withColumn("violation", F.coalesce("violation", rule))
    return judged.where("violation is null").drop("violation"), judged.where("violation is not null")


def last_n(events: DataFrame, n: int = 100) -> DataFrame:
    """The last n events of each user (batch)."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def expired(events: DataFrame, seconds: int, as_of: str) -> DataFrame:
    """user_id, written_at, expired of each user's last write: expired exactly at the deadline; a stream keeps one time a user."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("written_at"))
    return last.withColumn("expired", F.col("written_at") + F.expr(f"interval {seconds} seconds") <= F.to_timestamp(F.lit(as_of)))


def stalled(events: DataFrame, seconds: int, terminal: str, as_of: str) -> DataFrame:
    """user_id, first_at of runs without a terminal event within their budget from the first event.

    One aggregation a run, so a stream keeps two times for each; its output mode is complete or update.
    """
    ends = F.when(F.col("event_type") == terminal, F.col("ts"))
    first = events.groupBy("user_id").agg(F.min("ts").alias("first_at"), F.min(ends).alias("ended_at"))
    deadline = F.col("first_at") + F.expr(f"interval {seconds} seconds")
    late = (deadline <= F.to_timestamp(F.lit(as_of))) & (F.col("ended_at").isNull() | (F.col("ended_at") > deadline))
    return first.where(late).select("user_id", "first_at")


def last_n_stream(events: DataFrame, n: int = 100) -> DataFrame:
    """user_id, event_ids of each user's last n events by ts and event_id, newest first, whenever they change.

    A stream's state for a user is n rows at most.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += zip(batch["ts"].astype("int64").tolist(), batch["event_id"].tolist())
            held = sorted(set(held), reverse=True)[:n]
        state.update(([t for t, _ in held], [e for _, e in held]))
        yield pd.DataFrame({"user_id": [key[0]], "event_ids": [[e for _, e in held]]})

    rows = events.select("user_id", "event_id", "ts")
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_ids array<bigint>", "ts array<bigint>, ids array<bigint>", "update", GroupStateTimeout.NoTimeout)


def cascade(documents: DataFrame, runs: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """runs and their children without what comes of the documents that were deleted."""
    gone = runs.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("run_id")
    return [runs.join(gone, "run_id", "left_anti"), *[c.join(gone, "run_id", "left_anti") for c in children]]


def cascade_stream(deletions: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run apply(document_ids, batch id) for each batch of a stream of deletions, once for each batch that is committed."""
    batches = deletions.select("document_id").writeStream.foreachBatch(lambda batch, nth: apply(batch.distinct(), nth))
    return batches.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events without repeats of one user's type and value; a stream keeps state for `late` only."""
    keys = ["user_id", "event_type", "value"]
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
