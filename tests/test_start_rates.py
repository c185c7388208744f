"""Starts per visitor in sliding windows, against plain counting over several batches."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from crawlscore.streaming import alerts

BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "created_at timestamp, ip_hash string"


def run(spark, folder, batches, **arguments):
    """The rows emitted for each batch, and the most rows of state."""
    emitted, held = [], 0
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        got = []

        def keep(batch, number):
            got.extend(batch.select(F.unix_micros("window_start"), "ip_hash", "starts").collect())

        running = alerts.start_rates(stream, **arguments).writeStream.outputMode("update").foreachBatch(keep).option(
            "checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        running.awaitTermination()
        held = max([held, *(s["numRowsTotal"] for p in running.recentProgress for s in p["stateOperators"])])
        emitted.append([tuple(row) for row in got])
    return emitted, held


def counted(rows, width=3600, step=300):
    want = Counter()
    for at, ip in rows:
        if at is not None:
            us = (at - BEGIN) // timedelta(microseconds=1) + int(BEGIN.timestamp()) * 1_000_000
            first = us // (step * 1_000_000) * step * 1_000_000
            while first > us - width * 1_000_000:
                want[first, ip] += 1
                first -= step * 1_000_000
    return want


@pytest.mark.parametrize("window, slide, width, step", [("1 hour", "5 minutes", 3600, 300), ("50 minutes", "15 minutes", 3000, 900), ("1 hour", "1 hour", 3600, 3600)])
def test_windows_of_several_batches(spark, tmp_path, window, slide, width, step):
    r = random.Random(3)
    ips, edges = ["a", "b", "", None], [0, 300, 3600, 7200, 7199.999999]
    seconds = [s + 0.0 for s in edges] + [r.uniform(0, 20_000) for _ in range(150)]
    rows = [(BEGIN + timedelta(microseconds=round(s * 1e6)), r.choice(ips)) for s in sorted(seconds)] + [(None, "a")]
    rows += rows[:9]  # repeated rows count again
    batches = [rows[:60], rows[60:120], rows[120:]]
    emitted, _ = run(spark, tmp_path, batches, window=window, slide=slide, late="1 day")
    newest = {}
    for got in emitted:
        assert len({row[:2] for row in got}) == len(got)
        newest |= {row[:2]: row[2] for row in got}
    assert newest == counted(rows, width, step)


def test_state_holds_two_rows_a_start(spark, tmp_path):
    rows = [(BEGIN + timedelta(minutes=7 * k), f"v{k}") for k in range(40)]
    emitted, held = run(spark, tmp_path, [rows])
    assert {row[:2]: row[2] for row in emitted[0]} == counted(rows)
    assert held <= 2 * len(rows)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    first, late = [(BEGIN + timedelta(hours=9), "a")], [(BEGIN, "a"), (BEGIN + timedelta(hours=9), "b")]
    emitted, _ = run(spark, tmp_path, [first, [(BEGIN + timedelta(hours=9), "a")], late])
    assert {row[:2] for row in emitted[2]} == set(counted(late[1:]))
