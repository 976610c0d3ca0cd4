"""Search-as-you-type events (event_id, user_id, ts, text): batch forms, and stream forms that equal them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfworks.functions.numbering import beside
from shelfworks.operators.browse import nonblank
from shelfworks.operators.search import HITS, search_many, upper_brand

WATERMARK = "10 minutes"


def debounce_batch(events: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """Batch: the last text of each user before a pause longer than ``gap``. A user's events may be in many tasks.

    An event is the last one before a pause if the user's next event is farther away than the gap; no session is formed.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).filter("ts IS NOT NULL").select("user_id", "event_id", "text", "ts")
    rows = beside(timed, ["user_id"], ["ts", "event_id"], F.col("ts"), "_next", after=True)
    return rows.filter(F.col("_next").isNull() | (F.col("_next.v") > F.col("ts") + F.expr(f"INTERVAL {gap}"))).drop("_next")


def debounce(events: DataFrame, gap: str = "300 milliseconds", watermark: str | None = None) -> DataFrame:
    """The last text of each user before a pause longer than ``gap``; works on batches and, with a watermark, on streams."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", watermark) if watermark else timed
    sessions = timed.groupBy("user_id", F.session_window("ts", gap).alias("w"))
    last = sessions.agg(F.max_by(F.struct("event_id", "text", "ts"), F.struct("ts", "event_id")).alias("l"))
    return last.select("user_id", "l.event_id", "l.text", "l.ts")


def distinct_until_changed(events: DataFrame) -> DataFrame:
    """Batch: events whose text differs from the same user's text before. A user's events may be in many tasks."""
    rows = beside(events, ["user_id"], ["ts", "event_id"], F.col("text"), "_b")
    return rows.filter(F.col("_b").isNull() | ~F.col("text").eqNullSafe(F.col("_b.v"))).drop("_b")


def distinct_until_changed_stream(events: DataFrame) -> DataFrame:
    """Stream: the same with the last text of each user as state; events come in time order from batch to batch.

    A user's events of one batch are put in order in one task; the source's rows for each trigger bound their number.
    """

    def changed(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        kept = []
        for i, text in zip(rows.index, rows["text"]):
            text = None if pd.isna(text) else text
            if not seen or text != last:
                kept.append(i)
            seen, last = True, text
        state.update((last,))
        yield rows.loc[kept, ["event_id", "user_id", "ts", "text"]]

    return events.groupBy("user_id").applyInPandasWithState(
        changed, "event_id bigint, user_id bigint, ts timestamp, text string", "text string", "append", GroupStateTimeout.NoTimeout
    )


def switch_latest(requests: DataFrame) -> DataFrame:
    """Batch: requests (with latency_s) answered before the same user's next request. A user's requests may be in many tasks."""
    rows = requests.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = beside(rows, ["user_id"], ["ts", "event_id"], F.col("_t"), "_next", after=True)
    ready = F.col("_t") + F.round(F.col("latency_s") * 1_000_000).cast("bigint")
    return rows.filter(F.col("_next").isNull() | (ready < F.col("_next.v"))).drop("_t", "_next")


def switch_latest_stream(requests: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Stream: the same with each user's open request as state.

    A request comes out when the next one turns out to be later than its answer, or once the watermark has passed its
    answer, so that no request can come in between any more. Requests come in time order from batch to batch.
    """

    def latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names = ["event_id", "user_id", "ts", "text"]
        if state.hasTimedOut:
            event_id, text, asked, _ = state.get
            state.remove()
            yield pd.DataFrame([(event_id, key[0], pd.Timestamp(asked, unit="us"), text)], columns=names)
            return
        held, out = state.get if state.exists else None, []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event_id, at, text, latency in zip(rows["event_id"], rows["ts"], rows["text"], rows["latency_s"]):
            asked = at.value // 1000
            if held is not None and held[3] < asked:
                out.append(held)
            held = (event_id, None if pd.isna(text) else text, asked, asked + round(latency * 1_000_000))
        passed, due = state.getCurrentWatermarkMs(), held[3] // 1000 + 1
        if due <= passed:
            out.append(held)
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(due)
        yield pd.DataFrame([(i, key[0], pd.Timestamp(t, unit="us"), x) for i, x, t, _ in out], columns=names)

    timed = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy("user_id").applyInPandasWithState(
        latest, "event_id bigint, user_id bigint, ts timestamp, text string", "event_id bigint, text string, asked bigint, ready bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def search_events(events: DataFrame, cat: DataFrame, k: int = HITS) -> DataFrame:
    """Non-blank events with their first k hits (``rn, id_phone, brand, model``), brands in capitals; a row of nulls without hits."""
    asked = nonblank(events).select(F.col("event_id").alias("query_id"), "text")
    hits = upper_brand(search_many(asked, cat, k))
    return asked.join(hits, "query_id", "left")


def search_stream(events: DataFrame, cat: DataFrame | Callable[[], DataFrame], path: str, checkpoint: str, k: int = HITS, available_now: bool = False):
    """The started stream that appends search_events() of every micro-batch to ``path``.

    With ``available_now`` it ends when it has taken what its source has. ``cat`` may be a function that gives the catalogue anew for each batch. Where a batch's search fails, its events have
    no hits, and the stream goes on.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        to = f"{path}/batch={batch_id}"
        try:
            search_events(batch, cat() if callable(cat) else cat, k).write.mode("overwrite").parquet(to)
        except PySparkException:
            none = [F.lit(None).cast(kind).alias(name) for name, kind in (("rn", "int"), ("id_phone", "bigint"), ("brand", "string"), ("model", "string"))]
            nonblank(batch).select(F.col("event_id").alias("query_id"), "text", *none).write.mode("overwrite").parquet(to)

    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
