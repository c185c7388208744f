"""Every operator as a query over the given tables, with an equivalent DuckDB statement."""

from crawlscore.suite import (  # noqa: F401  (importing registers the queries)
    checks, extension, fixes, history, linkgraph, payloads, scores, shots, streams, structured, texts,
)
from crawlscore.suite.corpus import ORACLES, QUERIES  # noqa: F401
