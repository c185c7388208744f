"""Similarities that bands and sketches are not fitted to are refused."""

import pytest

from crawlscore.llm import near_dedup


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError, match="80"):
        near_dedup.linked(None, percent=79)
