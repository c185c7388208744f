"""Patterns that only ask whether a text holds something, against the full ones they stand for."""

import random
import time

from crawlscore import fixed_values as fv
from crawlscore.operators.checks.features import FEATURES

PHRASES = (
    r"(?iu)testimonial|reviews?\b|what (our )?(clients|customers|people) say|trusted by|"
    r"our clients|happy (clients|customers)|case stud|rated \d|★|google reviews|trustpilot|"
    r"clutch|success stor|পর্যালোচনা"
)
PIECES = [
    "Testimonial", "REVIEWS", "review", "reviewed", "what our clients say", "What people say", "what our people", "trusted by",
    "Trusted", "our CLIENTS", "happy customers", "happy people", "case study", "rated 5", "rated five", "★", "trustpilot", "Clutch",
    "ſucceſs ſtor", "teſtimonial", "success stor", "পর্যালোচনা", "পর্যা", "a@b.c", "@b.c", "a@.c", "a@b", "a@b.", "x.+-@_-.-", "é@b.c",
    "a@@b.c", "a@b c.d", "@", ".", "-", "w", "t", "r", " ", "\n", "",
]


def test_signs_are_found_where_the_patterns_are(spark):
    r = random.Random(5)
    texts = PIECES + ["".join(r.choice(PIECES) for _ in range(r.randint(1, 4))) for _ in range(3000)] + [None]
    rows = spark.createDataFrame([(t,) for t in texts], "visible_text string").selectExpr(
        f"(visible_text RLIKE r\"{fv.EMAIL}\") <=> ({FEATURES['has_email']}) AS mail", f"({FEATURES['has_email']}) AS has_mail",
        f"(visible_text RLIKE r\"{PHRASES}\") <=> ({FEATURES['social_proof_words']}) AS words", f"({FEATURES['social_proof_words']}) AS has_words")
    found = rows.collect()
    assert all(row.mail and row.words for row in found)
    for name in ("has_mail", "has_words"):
        assert {row[name] for row in found} == {True, False, None}


def test_a_very_long_word_is_searched_once(spark):
    text = spark.createDataFrame([("a" * 300_000,)], "visible_text string")
    began = time.perf_counter()
    assert text.selectExpr(FEATURES["has_email"]).head()[0] is False
    assert time.perf_counter() - began < 10
