"""Audit events as streams: page features, rates, and requests that reuse an audit.

Rows later than the watermark are dropped. Timers and rows held for their order are in `keyed`, results of whole
sites in `sites`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from crawlscore import fixed_values as fv
from crawlscore.operators.checks.features import FEATURES, layered
from crawlscore.sources import pages as pg
from crawlscore.streaming.keyed import bucket, with_rocksdb


def page_features(pages: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The row-local part of the checks over a stream of crawled pages (append mode): all features, or those named."""
    names = sorted(FEATURES) if names is None else names
    return layered(pg.page_docs(pages), FEATURES, set(names)).select(
        "audit_id", "page_key", "final_url", *names)


def start_rates(starts: DataFrame, window: str = "1 hour", slide: str = "5 minutes",
                late: str = "10 minutes") -> DataFrame:
    """Starts per visitor in sliding windows.

    In update mode a changed block emits all its windows, also those whose count is as before.
    """
    return block_rates(rate_blocks(starts, window, slide, late), window, slide)


def _microseconds(text: str) -> int:
    return int(pd.Timedelta(text) // pd.Timedelta(1, "us"))


def _slots(window: str, slide: str) -> list[str]:
    """A column for each window of a block: as many windows, one `slide` apart, as a start lies in."""
    width, step = _microseconds(window), _microseconds(slide)
    return [f"starts_{k}" for k in range(-(-width // step))]


def rate_blocks(starts: DataFrame, window: str = "1 hour", slide: str = "5 minutes",
                late: str = "10 minutes") -> DataFrame:
    """Starts per visitor in blocks of successive windows, with one count for each window of the block.

    A start lies in many windows, but in two blocks at most, so the shuffle and the state hold two rows a start and not
    one for each window. The state of a block ends when the watermark has passed all its windows: a window takes late rows
    until then, never shorter than by itself. State is kept in RocksDB, outside the executors' heap.
    """
    slots, width, step = _slots(window, slide), _microseconds(window), _microseconds(slide)
    block = len(slots) * step
    rows = with_rocksdb(starts).withWatermark("created_at", late).withColumn(
        "block", F.window("created_at", f"{2 * block} microseconds", f"{block} microseconds"))
    rows = rows.select("block", "ip_hash", (F.unix_micros("created_at") - F.unix_micros("block.start")).alias("at"))
    return rows.groupBy("block", "ip_hash").agg(*[
        F.sum(F.col("at").between(k * step, k * step + width - 1).cast("long")).alias(slot) for k, slot in enumerate(slots)
    ]).select(F.col("block.start").alias("block_start"), "ip_hash", *slots)


def block_rates(blocks: DataFrame, window: str = "1 hour", slide: str = "5 minutes") -> DataFrame:
    """The windows of blocks that hold a start."""
    slots, step = _slots(window, slide), _microseconds(slide)
    pairs = [c for k, slot in enumerate(slots) for c in (F.lit(k * step).cast("long"), F.col(slot))]
    rows = blocks.select("block_start", "ip_hash", F.stack(F.lit(len(slots)), *pairs).alias("later", "starts"))
    return rows.where("starts > 0").select(
        F.timestamp_micros(F.unix_micros("block_start") + F.col("later")).alias("window_start"), "ip_hash", "starts")


def daily_mails(mails: DataFrame, late: str = "1 hour") -> DataFrame:
    """Report mails per audit and day, the tumbling case."""
    return mails.withWatermark("created_at", late).groupBy(
        F.window("created_at", "1 day"), "checkup_id").agg(F.count("*").alias("sent")).select(
        F.col("window.start").alias("day"), "checkup_id", "sent")


def decided_requests(requests: DataFrame, audits: DataFrame, hours: int = fv.REUSE_HOURS,
                     late: str = "1 hour") -> DataFrame:
    """Every request, and whether it starts an audit: not if its address has a finished one that is young enough.

    `requests` has id, url, requested_at; `audits`, the finished ones, url and created_at, from which the
    reuse time counts (audits still running are another rule). A request is decided when it arrives, by its own time
    and all audits that have arrived. State: the times an address is covered, as (first, last) audit of each run
    of audits no more than the reuse time apart; those that the watermark has passed are forgotten. Addresses are
    dealt to buckets, and those of a bucket handled together as columns.
    """
    reuse = hours * 3600 * 1_000_000
    events = requests.select("url", "id", F.col("requested_at").alias("at"), F.lit(False).alias("finished")).unionByName(
        audits.select("url", F.lit(None).cast("bigint").alias("id"), F.col("created_at").alias("at"),
                      F.lit(True).alias("finished")))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        spans = pd.DataFrame(dict(zip(("url", "first", "last"), state.get if state.exists else ([], [], []))))
        asked: list[pd.DataFrame] = []
        if not state.hasTimedOut:
            for rows in frames:  # one bounded batch after another; all audits count before the first decision
                done = rows["finished"]
                if done.any():
                    new = pd.DataFrame({"url": rows["url"][done], "first": rows["us"][done], "last": rows["us"][done]})
                    spans = joined_spans(new if spans.empty else pd.concat([spans, new]), reuse)
                if not done.all():
                    asked.append(rows.loc[~done, ["id", "url", "us"]])
        kept = spans[spans["last"] + reuse >= mark * 1000]
        if len(kept):
            state.update((kept["url"].tolist(), kept["first"].tolist(), kept["last"].tolist()))
            state.setTimeoutTimestamp(max((int(kept["last"].min()) + reuse) // 1000, mark) + 1)
        elif state.exists:
            state.remove()
        for rows in asked:
            yield pd.DataFrame({"id": rows["id"].astype("int64"), "url": rows["url"], "accepted": ~covered(rows, spans, reuse)})

    return events.withWatermark("at", late).withColumn("us", F.unix_micros("at")).withColumn(
        "bucket", bucket("url")).groupBy("bucket").applyInPandasWithState(
        run, "id bigint, url string, accepted boolean", "url array<string>, first array<bigint>, last array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout)


def merged_spans(spans: list[tuple[int, int]], reach: int) -> list[tuple[int, int]]:
    """Sorted (first, last) spans; those no more than `reach` apart become one."""
    joined = joined_spans(pd.DataFrame(spans, columns=["first", "last"]).assign(url=""), reach)
    return list(zip(joined["first"].tolist(), joined["last"].tolist()))


def joined_spans(spans: pd.DataFrame, reach: int) -> pd.DataFrame:
    """Sorted (first, last) spans of each url; those of a url no more than `reach` apart become one."""
    spans = spans.astype({"first": "int64", "last": "int64"})
    address, _ = pd.factorize(spans["url"], use_na_sentinel=False)
    order = np.lexsort((spans["last"].to_numpy(), spans["first"].to_numpy(), address))
    spans, address = spans.iloc[order], address[order]
    ends = spans["last"].groupby(address).cummax().to_numpy()
    begins = np.ones(len(spans), dtype=bool)
    begins[1:] = (address[1:] != address[:-1]) | (spans["first"].to_numpy()[1:] - ends[:-1] > reach)
    closes = np.append(begins[1:], True)[:len(spans)]
    return pd.DataFrame({"url": spans["url"].to_numpy()[begins], "first": spans["first"].to_numpy()[begins], "last": ends[closes]})


def covered(rows: pd.DataFrame, spans: pd.DataFrame, reach: int) -> np.ndarray:
    """Which rows (url, us) lie in a span of their url, or no more than `reach` after it."""
    address, _ = pd.factorize(pd.concat([spans["url"], rows["url"]]), use_na_sentinel=False)
    at = np.concatenate([spans["first"].to_numpy(np.int64), rows["us"].to_numpy(np.int64)])
    asks = np.arange(len(at)) >= len(spans)
    order = np.lexsort((asks, at, address))  # a span comes before the requests of its first moment
    before = np.maximum.accumulate(np.where(asks[order], -1, np.arange(len(at))))  # place of the last span up to here
    span = np.where(before >= 0, order[before], -1)
    until = np.append(spans["last"].to_numpy(np.int64) + reach, 0)  # the last entry stands for no span
    hit = (span >= 0) & (address[span] == address[order]) & (at[order] <= until[span])
    out = np.empty(len(at), dtype=bool)
    out[order] = hit
    return out[len(spans):]


def accepted_requests(requests: DataFrame, audits: DataFrame, hours: int = fv.REUSE_HOURS,
                      late: str = "1 hour") -> DataFrame:
    """The requests that start an audit."""
    return decided_requests(requests, audits, hours, late).where("accepted").drop("accepted")
