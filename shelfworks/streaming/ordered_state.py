"""Search-as-you-type events as streams with state of their own: events in the order of their time, however they come.

Users are dealt out to cells by a hash, and a cell's users are judged together in columns: a stream calls Python a few
times for each cell and batch, however many users there are. A cell keeps its events, as Arrow blobs, until the watermark has
passed them, so that none can come in between any more; a timer wakes the cell up then. What has passed is put in order and
judged against the row that is kept of each user. What is open came in during the watermark's delay and one batch, not in a
user's whole history. State lies in RocksDB; a stream that is started again from its checkpoint goes on where it was. The
number of cells belongs to the checkpoint: a cell's users and its events of a batch should fit into a task (CELLS for some
hundred million users; more for more).

Defined cases: events older than the watermark are dropped, and counted (dropped_late()); a null text is a text of its own;
events of one time go by their event_id; a null user is a user.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "event_id bigint, user_id bigint, at bigint, text string"
#: Cells that users are dealt out to, and rows in one blob of a cell's state.
CELLS, BLOB_ROWS = 1024, 50_000
_TYPES = {"nobody": pa.bool_(), "user_id": pa.int64(), "at": pa.int64(), "event_id": pa.int64(), "text": pa.string(), "ready": pa.int64()}
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings that a stream is started with: where state lies, and sessions merged within a task before their rows are dealt out.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


@contextmanager
def stream_settings(spark: SparkSession) -> Iterator[None]:
    """A session with SETTINGS while streams are started; each keeps them, and the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def dropped_late(query) -> int:
    """Rows that a stream has dropped since it was started, as they were older than the watermark."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def _packed(rows: pd.DataFrame) -> bytes:
    """A frame as Arrow bytes; whole numbers with nulls keep their type."""
    out = pa.BufferOutputStream()
    table = pa.Table.from_pandas(rows, preserve_index=False, schema=pa.schema([(c, _TYPES[c]) for c in rows.columns]))
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_all().to_pandas()


class _Cell(StatefulProcessor):
    """The events of a cell's users: ``open`` ones, which the watermark has not passed, and one row ``kept`` of each user."""

    COLUMNS: tuple[str, ...] = ("nobody", "user_id", "at", "event_id", "text")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "rows binary")
        self.kept = handle.getListState("kept", "rows binary")

    def handleInputRows(self, key, rows, timerValues):
        new = [b[list(self.COLUMNS)] for b in rows]
        if new:
            self.handle.registerTimer(max(int(b["at"].max()) for b in new if len(b)) // 1000 + 1)
        yield self._output(self._judged(new, 1000 * timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._output(self._judged([], 1000 * timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass

    def _judged(self, new: list[pd.DataFrame], watermark: int) -> pd.DataFrame:
        raise NotImplementedError

    def _held(self, state) -> list[pd.DataFrame]:
        return [_unpacked(r[0]) for r in state.get()] if state.exists() else []

    def _hold(self, state, rows: pd.DataFrame) -> None:
        if len(rows):
            state.put([(_packed(rows.iloc[k : k + BLOB_ROWS]),) for k in range(0, len(rows), BLOB_ROWS)])
        elif state.exists():
            state.clear()

    def _in_order(self, new: list[pd.DataFrame], watermark: int, idle: bool) -> tuple[pd.DataFrame, pd.Series, pd.Series] | None:
        """What is kept of each user and then what the watermark has passed, in order, with whether a row has just passed and whether it follows one of its user.

        None where nothing has passed, unless ``idle`` rows kept are asked for too. Other open rows stay in the state.
        """
        all_ = [*self._held(self.open), *new]
        rows = pd.concat(all_, ignore_index=True) if all_ else None
        due = rows["at"] <= watermark if all_ else None
        passed = rows[due] if all_ else None
        if all_ and (new or len(passed)):
            self._hold(self.open, rows[~due])
        if not idle and (passed is None or not len(passed)):
            return None
        parts = [(b, False) for b in self._held(self.kept)] + ([(passed, True)] if passed is not None and len(passed) else [])
        if not parts:
            return None
        both = pd.concat([b.assign(passed=p) for b, p in parts], ignore_index=True)
        both = both.sort_values(["nobody", "user_id", "passed", "at", "event_id"], ignore_index=True)
        # a fill value keeps the column whole numbers, of which doubles would take neighbours for equal
        follows = (both["user_id"] == both["user_id"].shift(fill_value=0)) & (both["nobody"] == both["nobody"].shift(fill_value=False))
        follows.iloc[0] = False
        return both, both.pop("passed"), follows

    def _output(self, rows: pd.DataFrame | None) -> pd.DataFrame:
        if rows is None or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("event_id", "Int64"), ("user_id", "Int64"), ("at", "Int64"), ("text", "object"))})
        user = rows["user_id"].astype("Int64").mask(rows["nobody"].astype(bool))
        return pd.DataFrame({"event_id": rows["event_id"], "user_id": user, "at": rows["at"], "text": rows["text"]})


def _run(events: DataFrame, processor: StatefulProcessor, watermark: str, cells: int, *more: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    # a null user as a number and a mark: pandas has no whole numbers with nulls
    user = [F.pmod(F.xxhash64("user_id"), F.lit(cells)).alias("cell"), F.col("user_id").isNull().alias("nobody"), F.coalesce("user_id", F.lit(0)).cast("bigint").alias("user_id")]
    timed = timed.select(*user, F.col("event_id").cast("bigint").alias("event_id"), "ts", F.unix_micros("ts").alias("at"), "text", *more)
    out = timed.groupBy("cell").transformWithStateInPandas(processor, OUTPUT, "append", "eventTime")
    return out.select("event_id", "user_id", F.timestamp_micros("at").alias("ts"), "text")


def changes(events: DataFrame, watermark: str, forget_after: str | None = None, cells: int = CELLS) -> DataFrame:
    """Events (event_id, user_id, ts, text) whose text differs from the same user's text before, by event time.

    ``forget_after`` is a time to live: after a longer pause a user's event counts as the first one, and what is kept of a
    user goes once the watermark has passed that time.
    """
    live = None if forget_after is None else int(pd.Timedelta(forget_after).total_seconds() * 1_000_000)

    class Changes(_Cell):
        def _judged(self, new, watermark):
            got = self._in_order(new, watermark, live is not None)
            if got is None:
                return None
            both, passed, follows = got
            code = pd.Series(pd.factorize(both["text"], use_na_sentinel=True)[0])  # one number for each text, -1 for none
            differs = ~follows | (code != code.shift())
            if live is not None:
                differs |= both["at"] - both["at"].shift(fill_value=0) > live
            last = both[~follows.shift(-1, fill_value=False)]
            if live is not None:
                last = last[last["at"] + live >= watermark]
                if len(last):
                    self.handle.registerTimer((int(last["at"].min()) + live) // 1000 + 1)
            self._hold(self.kept, last)
            return both[differs & passed]

    return _run(events, Changes(), watermark, cells)


def latest_answers(requests: DataFrame, watermark: str, cells: int = CELLS) -> DataFrame:
    """Requests (event_id, user_id, ts, text, latency_s) that are answered before the same user's next one, by event time.

    The newest request that the watermark has passed is held until the next one or, at a timer, until the watermark has
    passed its answer.
    """

    class Latest(_Cell):
        COLUMNS = (*_Cell.COLUMNS, "ready")

        def _judged(self, new, watermark):
            got = self._in_order(new, watermark, True)
            if got is None:
                return None
            both, _, follows = got
            newest = ~follows.shift(-1, fill_value=False)
            # any request to come is later than the watermark, and so than an answer that it has passed
            answered = (~newest & (both["ready"] < both["at"].shift(-1, fill_value=0))) | (newest & (both["ready"] <= watermark))
            held = both[newest & ~answered]
            if len(held):
                self.handle.registerTimer(int(held[["ready", "at"]].max(axis=1).min()) // 1000 + 1)
            self._hold(self.kept, held)
            return both[answered]

    ready = F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("latency_s") * 1_000_000).cast("bigint")
    return _run(requests.withColumn("ready", ready), Latest(), watermark, cells, "ready")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Run a stream over all that its source has now, appending to Parquet files; gives how many late rows it dropped."""
    with stream_settings(stream.sparkSession):
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return dropped_late(query)
