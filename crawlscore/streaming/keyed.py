"""Keyed state in event time: timers per audit, and rows held per address until their order is certain.

Keys are dealt out to buckets, and one call of a processor handles all keys of its bucket as columns: a call per key
costs several round trips to the state store, which no number of audits can afford. State is kept in RocksDB, outside
the workers' memory, and every state ends: by its timer or by an age in event time. A bucket has one timer, that of its
earliest key. Rows behind the watermark are dropped before they reach a processor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from crawlscore import fixed_values as fv

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets that keys are dealt to.
BUCKETS = 1024
#: Rows of one stored piece of a bucket's state.
PIECE = 50_000


def bucket(key: str) -> Column:
    """The bucket of a key; null is a key like any other."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def with_rocksdb(df: DataFrame) -> DataFrame:
    """Processors with several states need this store; a restarted stream keeps the one it began with."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return df


def _packed(table: pa.Table) -> list[tuple[bytes]]:
    """A table as the pieces of a list state."""
    pieces = []
    for batch in table.combine_chunks().to_batches(max_chunksize=PIECE):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        pieces.append((sink.getvalue().to_pybytes(),))
    return pieces


def _unpacked(pieces, schema: pa.Schema) -> pa.Table:
    tables = [pa.ipc.open_stream(bytes(row[0])).read_all() for row in pieces]
    return pa.concat_tables(tables) if tables else schema.empty_table()


class _Buckets(StatefulProcessor):
    """Rows of a bucket's keys, held as pieces of columns, and the bucket's one timer."""

    HELD: pa.Schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "rows binary")
        self.timer = handle.getValueState("timer", "at bigint")

    def _hold(self, rows: pa.Table) -> None:
        self.held.appendList(_packed(rows))

    def _held(self) -> pa.Table:
        return _unpacked(self.held.get(), self.HELD) if self.held.exists() else self.HELD.empty_table()

    def _keep(self, rows: pa.Table) -> None:
        if rows.num_rows:
            self.held.put(_packed(rows))
        else:
            self.held.clear()

    def _wake(self, at: int) -> None:
        """The bucket's timer goes off at `at`, or earlier if it was to."""
        at = int(at)
        if self.timer.exists():
            known = self.timer.get()[0]
            if known <= at:
                return
            self.handle.deleteTimer(known)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


class StuckAudits(_Buckets):
    """One alert for each audit without an end when the watermark passes its last possible one."""

    HELD = pa.schema([("id", pa.int64()), ("us", pa.int64()), ("ended", pa.bool_())])

    def __init__(self, seconds: int):
        self.patience = seconds * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:  # an end is remembered too, as its start may come after it
            self._hold(pa.Table.from_pandas(frame[["id", "us", "ended"]], self.HELD, preserve_index=False))
            self._wake(int(frame["us"].min()) // 1000 + self.patience)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        audits = self._held().group_by("id").aggregate([("us", "min"), ("ended", "max")]).rename_columns(["id", "us", "ended"])
        due = audits["us"].to_numpy() // 1000 + self.patience
        passed = due <= timerValues.getCurrentWatermarkInMs()
        self._keep(audits.filter(pa.array(~passed)))
        if not passed.all():
            self._wake(due[~passed].min())
        alerts = audits.filter(pa.array(passed & ~audits["ended"].to_numpy()))
        if alerts.num_rows:
            yield pd.DataFrame({"id": alerts["id"].to_pandas(), "started": pd.to_datetime(alerts["us"].to_numpy(), unit="us")})


def stuck_audits(events: DataFrame, seconds: int = fv.AUDIT_TIMEOUT_SECONDS + fv.STUCK_GRACE_SECONDS,
                 late: str = "1 minute") -> DataFrame:
    """Audits whose end does not arrive in time: an event-time timer per audit.

    `events` has id, status, at. An end that comes before the watermark passes the timer, in whatever order, means no
    alert; the state of either kind of audit ends with the timer.
    """
    rows = with_rocksdb(events).withWatermark("at", late).select(
        bucket("id").alias("bucket"), "id", "at", F.unix_micros("at").alias("us"),
        F.coalesce(F.col("status").isin("done", "failed"), F.lit(False)).alias("ended"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        StuckAudits(seconds), "id bigint, started timestamp", "append", "eventTime")


class ScoreDrops(_Buckets):
    """Audits of an address in order of time: held until the watermark has passed them, then compared with the one before."""

    #: A bucket waits for the end of its earliest row's step.
    STEP = 60_000
    HELD = pa.schema([("url", pa.string()), ("us", pa.int64()), ("id", pa.int64()), ("health_score", pa.int32())])
    LAST = pa.schema([("url", pa.string()), ("us", pa.int64()), ("health_score", pa.int32())])

    def __init__(self, drop: int, forget_ms: int):
        self.drop, self.forget = drop, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getListState("last", "rows binary")

    def _end_of_step(self, us: int) -> int:
        return (int(us) // 1000 // self.STEP + 1) * self.STEP

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self._hold(pa.Table.from_pandas(frame[self.HELD.names], self.HELD, preserve_index=False))
            self._wake(self._end_of_step(frame["us"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self._held()
        is_due = held["us"].to_numpy() < passed
        due, rest = held.filter(pa.array(is_due)), held.filter(pa.array(~is_due))
        known = _unpacked(self.last.get(), self.LAST) if self.last.exists() else self.LAST.empty_table()
        if due.num_rows:
            self._keep(rest)
        rows = pa.concat_tables([known, due], promote_options="default").to_pandas()
        address, _ = pd.factorize(rows["url"], use_na_sentinel=False)
        fresh = np.arange(len(rows)) >= known.num_rows
        # by address, the score remembered first, then the audits due in order of time
        order = np.lexsort((rows["id"].fillna(0).to_numpy(), rows["us"].to_numpy(), fresh, address))
        rows, address, fresh = rows.iloc[order], address[order], fresh[order]
        same = np.concatenate([[False], address[1:] == address[:-1]]) if len(rows) else np.zeros(0, dtype=bool)
        delta = rows["health_score"].astype("float64").diff().where(same)
        newest = np.concatenate([~same[1:], [True]]) if len(rows) else same
        last = rows[newest].assign(fresh=fresh[newest])
        waiting = last["url"].isin(rest["url"].to_pandas())
        last = last[last["fresh"] | waiting | (last["us"] + self.forget * 1000 > passed)]
        if len(last):
            self.last.put(_packed(pa.Table.from_pandas(last[self.LAST.names], self.LAST, preserve_index=False)))
        else:
            self.last.clear()
        wakes = [self._end_of_step(rest["us"].to_numpy().min())] if rest.num_rows else []
        if len(last):
            wakes.append(int(last["us"].min()) // 1000 + self.forget + 1)
        if wakes:
            self._wake(max(min(wakes), timerValues.getCurrentWatermarkInMs() + 1))
        alerts = (delta <= -self.drop).to_numpy() & fresh
        if alerts.any():
            yield pd.DataFrame({"id": rows["id"][alerts].astype("int64"), "url": rows["url"][alerts], "delta": delta[alerts].astype("int32")})


def score_drops(audits: DataFrame, drop: int = fv.ALERT_ON_DROP, late: str = "1 hour", forget_days: int = 400) -> DataFrame:
    """Audits that lost points against the one before in time, however they arrived within `late`.

    `audits` has id, url, health_score, created_at. State of an address: the audits that the watermark has not passed, and
    the last score before them, which is forgotten after `forget_days` without an audit.
    """
    rows = with_rocksdb(audits).withWatermark("created_at", late).select(
        bucket("url").alias("bucket"), "id", "url", "health_score", "created_at", F.unix_micros("created_at").alias("us"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        ScoreDrops(drop, forget_days * 86_400_000), "id bigint, url string, delta int", "append", "eventTime")
