"""Keyed processors handle the keys of a bucket as columns: calls to the state store do not grow with the keys."""

import pandas as pd
import pytest

from crawlscore.streaming import keyed


class State:
    """A list or value state that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, []

    def exists(self):
        return bool(self.rows)

    def get(self):
        self.calls.append("get")
        return self.rows if self.many else self.rows[0]

    def put(self, rows):
        self.calls.append("put")
        self.rows = list(rows)

    def appendList(self, rows):
        self.calls.append("append")
        self.rows = [*self.rows, *rows]

    def update(self, row):
        self.put([row])

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def _state(self, many):
        state = State(self.calls)
        state.many = many
        return state

    def getListState(self, name, schema):
        return self._state(True)

    def getValueState(self, name, schema):
        return self._state(False)

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.discard(at)


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def batch(processor, handle, rows, mark):
    """What a micro-batch does with one bucket: its rows, then the timers that the watermark has passed."""
    list(processor.handleInputRows((0,), iter([rows] if rows is not None else []), Mark(mark)))
    out = []
    for timer in sorted(t for t in handle.timers if t <= mark):
        handle.timers.discard(timer)
        out += processor.handleExpiredTimer((0,), Mark(mark), None)
    return sorted(pd.concat(out).itertuples(index=False, name=None)) if out else []


@pytest.mark.parametrize("audits", [10, 10_000])
def test_stuck_audits_of_a_bucket_together(audits):
    processor, handle = keyed.StuckAudits(100), Handle()
    processor.init(handle)
    ids = range(audits)
    begun = pd.DataFrame({"id": ids, "us": [i * 1_000_000 for i in ids], "ended": False})
    assert batch(processor, handle, begun, 0) == []
    ended = pd.DataFrame({"id": ids, "us": [i * 1_000_000 + 500 for i in ids], "ended": True})[1::2]
    assert batch(processor, handle, ended, 50_000) == []
    half = audits // 2  # the timers of ids up to `half` pass first
    got = batch(processor, handle, None, (half + 100) * 1000)
    assert [r[0] for r in got] == [i for i in ids if i <= half and i % 2 == 0]
    assert got[-1][1] == pd.Timestamp(got[-1][0], unit="s")
    rest = batch(processor, handle, None, 10**9)
    assert [r[0] for r in rest] == [i for i in ids if i > half and i % 2 == 0]
    assert not processor.held.exists() and not handle.timers and len(handle.calls) < 30


@pytest.mark.parametrize("addresses", [3, 2_000])
def test_score_drops_of_a_bucket_together(addresses):
    processor, handle = keyed.ScoreDrops(5, 86_400_000), Handle()
    processor.init(handle)
    urls = [None, *(f"u{i}" for i in range(1, addresses))]

    def rows(score, hour, number):
        return pd.DataFrame({"url": urls, "us": hour * 3_600_000_000, "id": range(number, number + addresses), "health_score": score})

    assert batch(processor, handle, rows(90, 1, 0), 0) == []
    late = rows(80, 2, 10_000)
    late["health_score"] = late["health_score"].astype("Int64").where(late.index != 1)  # one audit without a score
    assert batch(processor, handle, pd.concat([rows(70, 3, 20_000), late]), 3_600_000 * 5 // 2) == [
        (10_000 + i, url, -10) for i, url in enumerate(urls) if i != 1]
    assert batch(processor, handle, None, 3_600_000 * 4) == [(20_000 + i, url, -10) for i, url in enumerate(urls) if i != 1]
    assert batch(processor, handle, None, 3_600_000 * 30) == [] and not processor.last.exists()  # forgotten after a day
    assert not handle.timers and len(handle.calls) < 60
