"""Keyed state with event-time timers: follow-ups that fall due or are cancelled by a reply, and caches whose entries expire.

Both decide when a timer goes off, that is when the watermark has passed it, so rows that come out of order, or late but
before the watermark, count as if they had come in order; later ones are dropped by Spark.  Keys share a state by their hash,
whose rows are held as packed batches and decided together, so what a state costs is not paid for every key and row.  A state
holds what its open timers need and is emptied by them, so it follows the rows of one waiting time, not the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States that all keys share: a state costs 10 to 17 ms of task time however few rows it holds, so more of them slow small tables.
#: A stream that goes on from a checkpoint needs the number that it began with.
BUCKETS = 4_096


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False).replace_schema_metadata()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(packed))).read_pandas()


class _Waiting(StatefulProcessor):
    """Rows of a bucket that wait for their time, and one timer: for the earliest.  What is over goes when the watermark has passed it."""

    columns: list[str] = []  # of the rows; at is a time in milliseconds

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.next = handle.getValueState("next", "at long")

    def close(self) -> None:
        pass

    def decided(self, rows: pd.DataFrame, over: pd.Series) -> pd.DataFrame:
        """What is told of the rows that are over, by all that are held."""
        raise NotImplementedError

    def _wait_until(self, at: int) -> None:
        """Sets the timer to an earlier time, or after it went off to a new one."""
        now = self.next.get()[0] if self.next.exists() else None
        if now is not None and now <= at:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = []
        for batch in rows:
            self.held.appendValue((_packed(batch[self.columns]),))
            first.append(int(batch["at"].min()))
        self._wait_until(min(first) + self.wait_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.concat([_unpacked(packed) for (packed,) in self.held.get()], ignore_index=True)
        over = rows["at"] + self.wait_ms <= timerValues.getCurrentWatermarkInMs()
        rest = rows[~over]
        self.next.clear()
        if len(rest):
            self.held.put([(_packed(rest),)])
            self._wait_until(int(rest["at"].min()) + self.wait_ms)
        else:
            self.held.clear()
        told = self.decided(rows, over)
        return iter([told] if len(told) else [])


def _run(rows: DataFrame, key: str, time: str, columns: list, late: str, processor: _Waiting, schema: str) -> DataFrame:
    """The processor over the columns, with the time in milliseconds as at, by buckets of the key; schema: its output."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = rows.withWatermark(time, late).select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), *columns, F.unix_millis(time).alias("at"), F.col(time).alias("event_time"))
    return timed.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode="EventTime")


class _FollowUps(_Waiting):
    """Rows: person, mail_id, reply (or else a mail) and at."""

    columns = ["person", "mail_id", "reply", "at"]

    def decided(self, rows: pd.DataFrame, over: pd.Series) -> pd.DataFrame:
        mails = rows.loc[over & ~rows["reply"], ["person", "mail_id", "at"]].sort_values("at")
        replies = rows.loc[rows["reply"], ["person", "at"]].sort_values("at")
        due = mails["at"] + self.wait_ms
        mails, due = mails.reset_index(drop=True), due.reset_index(drop=True)
        if len(mails) and len(replies):
            answer = pd.merge_asof(mails, replies.assign(answer=replies["at"]), on="at", by="person", direction="forward", allow_exact_matches=False)["answer"].astype("Int64")
        else:
            answer = pd.Series(pd.NA, index=mails.index, dtype="Int64")
        answered = (answer <= due).fillna(False).astype(bool)
        return pd.DataFrame({"person": mails["person"], "mail_id": mails["mail_id"], "state": answered.map({True: "cancelled", False: "due"}), "at": due.where(~answered, answer).astype("int64")})


def follow_ups(mails: DataFrame, replies: DataFrame, wait_ms: int, late: str = "10 minutes") -> DataFrame:
    """mails: person, mail_id, at; replies: person, at; streams, times in milliseconds.

    person, mail_id, state (due, or cancelled if the person replied after the mail and within the wait), at (when it falls due,
    or the first such reply), once the watermark has passed the wait.
    """
    both = mails.select("person", F.col("mail_id").cast("long"), "at").union(replies.select("person", F.lit(None).cast("long"), "at")).where("person is not null and at is not null")
    kind = both.schema["person"].dataType.simpleString()
    columns = [F.col("person"), F.coalesce("mail_id", F.lit(0)).alias("mail_id"), F.col("mail_id").isNull().alias("reply")]
    told = _run(both, "person", "at", columns, late, _FollowUps(wait_ms), f"person {kind}, mail_id long, state string, at long")
    return told.withColumn("at", F.timestamp_millis("at"))


class _Entries(_Waiting):
    """Rows: key, entry and at; an entry lives until the next one, or until its time is over."""

    columns = ["key", "entry", "at"]

    def decided(self, rows: pd.DataFrame, over: pd.Series) -> pd.DataFrame:
        rows = rows.assign(over=over).sort_values(["key", "at", "entry"], ignore_index=True)
        last = rows["key"] != rows["key"].shift(-1)
        ends = rows["at"] + self.wait_ms
        out = rows["over"] & (last | (rows["at"].shift(-1, fill_value=0) > ends))
        return pd.DataFrame({"key": rows["key"], "entry": rows["entry"], "expired_at": ends})[out]


def expiries(writes: DataFrame, live_ms: int, late: str = "10 minutes") -> DataFrame:
    """writes: key, entry (a whole number), at; a stream, times in milliseconds.

    key, entry, expired_at of each entry that no later write of its key has taken the place of in time; of writes at the same
    time the largest entry counts.
    """
    kind = writes.schema["key"].dataType.simpleString()
    rows = writes.select("key", F.col("entry").cast("long"), "at").where("key is not null and entry is not null and at is not null")
    told = _run(rows, "key", "at", [F.col("key"), F.col("entry")], late, _Entries(live_ms), f"key {kind}, entry long, expired_at long")
    return told.withColumn("expired_at", F.timestamp_millis("expired_at"))


def new_keys(rows: DataFrame, known: DataFrame, key: list[str], time: str, within: str = "10 minutes") -> DataFrame:
    """The first row of each key that the static table known does not hold; a key is forgotten when the watermark has passed it
    by `within`.  What is known needs no state: it is joined, before anything is remembered."""
    fresh = rows.withWatermark(time, within).join(known.select(*key).distinct(), key, "left_anti")
    return fresh.dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, place: str, schema: str) -> DataFrame:
    """Runs the stream over all that is there and gives what it wrote; place: a shared folder of its own."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{place}/rows")
