"""Streams of mails and replies: keyed dedup, first replies, follow-ups, and a breaker for failing tools.

Each function takes and gives a streaming DataFrame (a batch one works too where no timer is needed); state is bounded
by watermarks, so it does not grow with the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLLOW_UP_DAYS = 3
FAILURES, MISSES, OFF_MINUTES = 3, 5, 15


def dedup(rows: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first row of each key; a key is forgotten when the watermark has passed."""
    if rows.isStreaming:
        return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])


def replies(sent: DataFrame, received: DataFrame, late: str = "1 hour", open_for: str = "30 days") -> DataFrame:
    """sent: mail_id, person, sent_at; received: reply_id, sender, reply_at.  Replies that came after the mail and while it is open."""
    s, r = sent.withWatermark("sent_at", late), received.withWatermark("reply_at", late)
    after = (F.col("person") == F.col("sender")) & (F.col("reply_at") > F.col("sent_at")) & (F.col("reply_at") <= F.col("sent_at") + F.expr(f"interval {open_for}"))
    return s.join(r, after).select("mail_id", "reply_id", "sent_at", "reply_at")


def schedule(sent: DataFrame, received: DataFrame, days: int = FOLLOW_UP_DAYS, late: str = "1 hour") -> DataFrame:
    """Follow-ups that fall due: mails without a reply within `days`; an outer join emits them when the watermark is past."""
    s, r = sent.withWatermark("sent_at", late), received.withWatermark("reply_at", late)
    due = F.col("sent_at") + F.expr(f"interval {days} days")
    answered = (F.col("person") == F.col("sender")) & (F.col("reply_at") > F.col("sent_at")) & (F.col("reply_at") <= due)
    return s.join(r, answered, "leftOuter").where("reply_id is null").select("mail_id", "person", due.alias("due_at"))


def breaker(calls: DataFrame) -> DataFrame:
    """calls: tool, at, outcome (ok, miss, failure).  A row whenever a tool goes off: tool, off_from, off_until.

    Three failures or five misses in a row switch a tool off for a quarter of an hour; calls in that time don't count.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        failures, misses, until = state.get if state.exists else (0, 0, 0)
        out = []
        rows = pd.concat(list(batches)) if not state.hasTimedOut else pd.DataFrame(columns=["at", "outcome"])
        for at, outcome in rows.sort_values("at")[["at", "outcome"]].itertuples(index=False):
            now = int(at.timestamp())
            if now < until:
                continue
            failures = failures + 1 if outcome == "failure" else 0 if outcome == "ok" else failures
            misses = misses + 1 if outcome == "miss" else 0 if outcome == "ok" else misses
            if failures >= FAILURES or misses >= MISSES:
                failures, misses, until = 0, 0, now + OFF_MINUTES * 60
                out.append((key[0], at, at + pd.Timedelta(minutes=OFF_MINUTES)))
        state.update((failures, misses, until))
        if out:
            yield pd.DataFrame(out, columns=["tool", "off_from", "off_until"])

    return calls.groupBy("tool").applyInPandasWithState(step, "tool string, off_from timestamp, off_until timestamp", "failures int, misses int, until long", "append", "NoTimeout")


def cancel(follow_ups: DataFrame, found: DataFrame) -> DataFrame:
    """Scheduled follow-ups of replied mails become cancelled, by reply; a batch step of foreachBatch."""
    hit = found.select("mail_id").distinct().withColumn("_hit", F.lit(True))
    joined = follow_ups.join(hit, "mail_id", "left")
    stop = F.col("_hit") & (F.col("status") == "scheduled")
    return joined.withColumns({"status": F.when(stop, "cancelled").otherwise(F.col("status")), "cancel_reason": F.when(stop, "replied").otherwise(F.col("cancel_reason"))}).drop("_hit")
