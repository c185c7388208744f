"""Requests of many addresses decided together, against a plain loop over each address."""

import bisect
import random

import pandas as pd
import pytest

from crawlscore.streaming import alerts


def plain_spans(spans, reach):
    out = []
    for first, last in sorted(spans):
        if out and first - out[-1][1] <= reach:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


@pytest.mark.parametrize("seed", range(200))
def test_spans_of_many_addresses(seed):
    r = random.Random(seed)
    urls, reach = [None, "a", "b", "c"][:r.randint(1, 4)], r.randint(0, 6)
    rows = [(r.choice(urls), at := r.randint(0, 60), at + r.randint(0, 8)) for _ in range(r.randint(0, 14))]
    spans = alerts.joined_spans(pd.DataFrame(rows, columns=["url", "first", "last"]), reach)
    got = {u: [] for u in urls}
    for url, first, last in spans.itertuples(index=False, name=None):
        got[url if isinstance(url, str) else None].append((first, last))
    want = {u: plain_spans([row[1:] for row in rows if row[0] == u], reach) for u in urls}
    assert got == want
    asked = [(r.choice(urls), r.randint(0, 80)) for _ in range(20)]

    def in_span(url, at):
        place = bisect.bisect_right([first for first, _ in want[url]], at) - 1
        return place >= 0 and at <= want[url][place][1] + reach

    assert alerts.covered(pd.DataFrame(asked, columns=["url", "us"]), spans, reach).tolist() == [in_span(*a) for a in asked]
