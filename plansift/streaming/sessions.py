"""Structured Streaming twins: session history with expiry, expiring facts, and the gate on a message flow.

State expires in event time: a session SESSION_TTL seconds after its last turn or touch, a fact after its own TTL. Timers drop what the watermark has
passed, so state holds live keys alone. Rows of a session take effect in order of time and id even if they come late, but within the watermark's delay; writes of
facts in that order within a batch. All operators need the RocksDB state store (STORE).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plansift.operators.state import SESSION_TTL, TURNS, is_urgent

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELAY = "1 hour"


def _micros(t) -> int:
    return pd.Timestamp(t).value // 1000


class _LastTurns(StatefulProcessor):
    """The last TURNS rows of a key. A turn or a touch renews the history for SESSION_TTL seconds, a delete drops it; a turn after that begins anew.

    What lies before the watermark is settled: the history as it was then, and when it was renewed. What is later is held row by row, by time and id, so that
    a row that comes late, but within the watermark's delay, takes its place in the order before the history is told. Of those only what can still matter stays.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # one value a key, as each call of the store is a round trip
        self.turns = handle.getValueState("turns", "history array<long>, at long, times array<long>, ids array<long>, actions array<string>")

    @staticmethod
    def _after(held: list[int], at: int | None, rows: list[tuple[int, int, str]]) -> tuple[list[int], int | None]:
        """History and time of renewal (micros) after rows, which are in order."""
        for t, i, action in rows:
            # whole seconds count, as in the batch twin
            if action == "delete" or at is not None and t // 1_000_000 - at // 1_000_000 > SESSION_TTL:
                held, at = [], None
            if action == "turn":
                held, at = [*held, i][-TURNS:], t
            elif action == "touch" and at is not None:  # of a session that there is
                at = t
        return held, at

    @staticmethod
    def _needed(rows: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Of rows in order those that can still matter, whatever comes late: none before the last delete, none before the TURNS-th last turn."""
        turns = 0
        for n in range(len(rows) - 1, -1, -1):
            turns += rows[n][2] == "turn"
            if rows[n][2] == "delete" or turns == TURNS:
                return rows[n:]
        return rows

    def _keep(self, held: list[int], at: int | None, pending: list[tuple[int, int, str]]) -> None:
        times, ids, actions = ([r[n] for r in pending] for n in range(3))
        self.turns.update((held, at, times, ids, actions))

    def _timer(self, last: int | None, timerValues, renew: bool) -> None:
        for old in list(self.handle.listTimers()) if renew else ():
            self.handle.deleteTimer(old)
        if last is not None:
            self.handle.registerTimer(max(last // 1000 + (SESSION_TTL + 1) * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        held, at = list(initialState["history"].iloc[0])[-TURNS:], _micros(initialState["last"].iloc[0])
        self._keep([int(i) for i in held], at, [])
        self._timer(at, timerValues, True)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.turns.get()
        held, at, times, ids, actions = known or ([], None, [], [], [])
        every = {(t, i): a for t, i, a in zip(times, ids, actions)}
        for b in rows:
            micros = np.maximum(b["ts"].to_numpy("datetime64[us]").astype(np.int64), _micros(pd.NaT)).tolist()
            every.update({(t, int(i)): a for t, i, a in zip(micros, b["id"], b["action"])})
        ordered = [(t, i, a) for (t, i), a in sorted(every.items())]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        due = [r for r in ordered if r[0] <= mark]
        later = self._needed(ordered[len(due) :])
        held, at = self._after(list(held), at, due)
        now, last = self._after(held, at, later)
        if at is None and not later:
            self.turns.clear()
        else:
            self._keep(held, at, later)
        self._timer(max((x for x in (last, later[-1][0] if later else None) if x is not None), default=None), timerValues, known is not None)
        yield pd.DataFrame({"key": [key[0]], "history": [now], "last": np.array(["NaT" if last is None else last], "datetime64[us]")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        return iter([])

    def close(self) -> None:
        pass


def last_turns(stream: DataFrame, key: str, ts: str, tie: str, action: str | None = None, delay: str = DELAY, start: DataFrame | None = None) -> DataFrame:
    """key, history, last after each micro-batch, in update mode; an empty history for a key that was dropped. action: turn (by default), touch or delete.

    Rows may come in any order within the delay. start: key, history, last of sessions that there are already, as the batch twin gives them.
    """
    what = F.lit("turn") if action is None else F.col(action)
    rows = stream.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.col(tie).cast("long").alias("id"), what.alias("action")).withWatermark("ts", delay)
    begun = None if start is None else start.select(F.col(key).alias("key"), F.col("history").cast("array<long>").alias("history"), F.col("last").cast("timestamp").alias("last")).groupBy("key")
    return rows.groupBy("key").transformWithStateInPandas(_LastTurns(), "key long, history array<long>, last timestamp", "update", "eventtime", initialState=begun)


class _Facts(StatefulProcessor):
    """The last write of a key, as long as it lives; answers reads. A failure is kept too, as a miss."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fact = handle.getValueState("fact", "at timestamp, payload string, negative boolean, ttl long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fact = self.fact.get() if self.fact.exists() else None
        fact = fact and (pd.Timestamp(fact[0]), fact[1], bool(fact[2]), int(fact[3]))
        wrote, out = False, []
        listed = [r for b in rows for r in zip(b["ts"], b["is_read"], b["id"], b["payload"], b["negative"], b["ttl_s"])]
        # a write at the time of a read comes before it; of writes at one time the highest id is last
        for t, read, i, payload, negative, ttl in sorted(listed, key=lambda r: (r[0], r[1], r[2])):
            if not read:
                fact, wrote = (t, payload, bool(negative), int(ttl)), True
                continue
            hit = fact is not None and not fact[2] and _micros(t) - _micros(fact[0]) <= fact[3] * 1_000_000
            out.append((key[0], int(i), hit, fact[1] if hit else None))
        if wrote:
            self.fact.update((fact[0].to_pydatetime(), fact[1], fact[2], fact[3]))
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(_micros(fact[0]) // 1000 + fact[3] * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(out, columns=["key", "read_id", "hit", "payload"]).astype({"key": "int64", "read_id": "int64", "hit": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.fact.clear()
        return iter([])

    def close(self) -> None:
        pass


def fact_cache(stream: DataFrame, key: str, ts: str, delay: str = DELAY) -> DataFrame:
    """key, read_id, hit, payload of the reads in a flow of reads and writes (is_read, id, payload, negative, ttl_s): what the latest write of the key at or before the read says, while it lives."""
    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"), "is_read", F.col("id").cast("long").alias("id"), F.col("payload").cast("string").alias("payload"), F.coalesce("negative", F.lit(False)).alias("negative"), F.coalesce(F.col("ttl_s").cast("long"), F.lit(0)).alias("ttl_s")).withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Facts(), "key long, read_id long, hit boolean, payload string", "append", "eventtime")


def gate(stream: DataFrame, message: str) -> DataFrame:
    """The urgent messages of a flow; stateless."""
    return stream.filter(is_urgent(F.col(message)))


def drained(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now, through a sink under path, and returns the rows it wrote."""
    spark: SparkSession = stream.sparkSession
    out = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = out.format("parquet").outputMode("append").option("path", f"{path}/rows").start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

        query = out.outputMode(mode).foreachBatch(lambda b, n: save(b.withColumnRenamed("batch", "_b") if "batch" in b.columns else b, n)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows") if mode == "append" else spark.read.parquet(f"{path}/rows")
