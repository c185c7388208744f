"""Requests decided against finished audits, over several batches."""

import datetime as dt

from crawlscore.streaming import alerts

START = dt.datetime(2024, 1, 1)
SCHEMA = "id bigint, url string, at timestamp, finished boolean"


def replay(spark, tmp_path, batches):
    """{id: (accepted, batch)} of rows (id, url, hour, finished) that arrive in batches."""
    source, found = str(tmp_path / "in"), {}

    def keep(batch, number):
        for r in batch.collect():
            assert r.id not in found
            found[r.id] = r.accepted

    for rows in batches:
        spark.createDataFrame([(i, u, START + dt.timedelta(hours=h), f) for i, u, h, f in rows], SCHEMA).write.mode("append").parquet(source)
        events = spark.readStream.schema(SCHEMA).parquet(source)
        decided = alerts.decided_requests(
            events.where("NOT finished").withColumnRenamed("at", "requested_at"),
            events.where("finished").withColumnRenamed("at", "created_at"), late="100 hours")
        decided.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "at")).trigger(
            availableNow=True).start().awaitTermination()
    return found


def test_reuse_counts_from_the_last_finished_audit(spark, tmp_path):
    found = replay(spark, tmp_path, [
        [(1, "a", 0, False), (None, "a", 1, True), (2, "a", 2, False), (3, "a", 25, False), (4, "a", 25.01, False), (5, "b", 5, False)],
        [(6, "a", 80, False), (None, "a", 90, True), (7, "a", 100, False), (8, "b", 6, False)],
        [(9, "a", 114, False), (10, "a", 115, False), (11, "a", 24, False), (12, "a", 60, False)],  # the last two are late
        [(None, "a", 400, True), (13, "a", 401, False), (14, "b", 402, False)],
        [(15, "a", 424, False), (16, "a", 425, False)],
    ])
    refused = {2, 3, 7, 9, 11, 13, 15}
    assert found == {i: i not in refused for i in range(1, 17)}


def test_spans():
    assert alerts.merged_spans([(9, 9), (1, 1), (4, 4), (2, 3)], 3) == [(1, 4), (9, 9)]
