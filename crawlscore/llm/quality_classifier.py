"""Quality classifier: document evidence combined with host and path rates by empirical Bayes.

1. Evidence. Simple ratios of a text are put into bins, and each bin adds a weight to the log odds of
   good against bad beside the prior (ridge-penalised logistic fit). The fit sees at most FIT_ROWS
   labelled documents, chosen by hash; everything else covers all rows.
2. Rates. Every document, labelled or not, adds its probability of being good to its host and to its
   path below the host. A host's rate is shrunk towards the global rate and a path's towards its
   host's, by pseudo counts that the spread between hosts (paths) gives, so sparse sites say little.
3. Posterior. Evidence plus the log odds of the path's rate, from which the document's own
   probability is taken out. Documents at THRESHOLD or above are kept.

`documents` has no addresses: there a source is the host and a language its path.

Defined results: a null or empty text has ratios of 0 and is judged like any other. Null hosts and
paths are groups of their own. Labels that are null are left out; several labels of one document
count with their mean; without labels the evidence is 0 and everything is kept. Repeated rows are
judged alike. Own columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common
from crawlscore.llm.quality_rules import STOP_WORDS

THRESHOLD = 0.5
PENALTY = 0.3
#: Labelled rows that the fit sees at most.
FIT_ROWS = 20_000
#: Probabilities are summed in whole millionths, so that sums do not depend on the order of rows.
UNIT = 1_000_000

#: Upper limits of the bins of each ratio.
EDGES = {
    "symbols_per_word": (1e-9, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0),
    "marks_per_word": (1e-9, 0.02, 0.05, 0.1, 0.25, 0.5, 1.0),
    "capitals_per_char": (1e-9, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5),
    "duplicate_line_share": (1e-9, 0.1, 0.2, 0.35, 0.5, 0.7),
    "mean_word_chars": (2.0, 3.0, 4.0, 4.5, 5.0, 5.5, 6.0, 7.0, 9.0),
    "stop_word_share": (1e-9, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4),
    "distinct_word_share": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "same_word_again_share": (0.02, 0.1, 0.3, 0.6),
    "words": (1.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0, 256.0, 512.0, 1024.0, 4096.0),
}


def _bins(df: DataFrame, text: str) -> DataFrame:
    """Adds `bins`, one bin number for each ratio."""
    blank = F.translate(F.col(text), common.WHITE, " " * len(common.WHITE))
    df = df.withColumn("w", F.array_remove(F.split(blank, " "), F.lit("")))
    df = df.withColumn("lines", F.filter(
        F.split(F.col(text), "\n"), lambda x: F.length(F.translate(x, common.WHITE, "")) > 0))
    stop = ", ".join(f"'{word}'" for word in dict.fromkeys(STOP_WORDS))
    words = F.greatest(F.size("w"), F.lit(1)).cast("double")
    chars = F.length(F.translate(F.col(text), common.WHITE, "")).cast("double")

    def count(characters: str) -> Column:
        return (F.length(text) - F.length(F.translate(F.col(text), characters, ""))).cast("double")

    ratios = {
        "symbols_per_word": count("#*$%&|<>") / words,
        "marks_per_word": count("!") / words,
        "capitals_per_char": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / F.greatest(chars, F.lit(1.0)),
        "duplicate_line_share": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("double")
        / F.greatest(F.size("lines"), F.lit(1)),
        "mean_word_chars": chars / words,
        "stop_word_share": F.expr(f"size(filter(w, x -> x IN ({stop})))").cast("double") / words,
        "distinct_word_share": F.size(F.array_distinct("w")).cast("double") / words,
        "same_word_again_share": F.expr("size(filter(w, (x, i) -> i > 0 AND x = w[i - 1]))").cast("double") / words,
        "words": F.size("w").cast("double"),
    }
    df = df.withColumn("ratios", F.array(*[ratios[name] for name in EDGES]))
    numbers = []
    for k, edges in enumerate(EDGES.values()):
        beyond = [(F.col("ratios")[k] >= edge).cast("int") for edge in edges]
        numbers.append(sum(beyond[1:], beyond[0]))
    return df.withColumn("bins", F.array(*numbers)).drop("w", "lines", "ratios")


@dataclass(frozen=True)
class Evidence:
    """Weights by ratio and bin, and the share of good documents among the labelled."""

    ratios: tuple[tuple[float, ...], ...]
    good: float

    def column(self, bins: str = "bins") -> Column:
        parts = [F.element_at(F.array(*[F.lit(x) for x in row]), F.col(bins)[k] + 1) for k, row in enumerate(self.ratios)]
        return sum(parts[1:], parts[0])


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def fit(features: DataFrame, labels: DataFrame, key: str, label: str, rows: int = FIT_ROWS) -> Evidence:
    """The bins' weights from the labelled documents; `features` has key and bins.

    Weights come from a bounded sample, about `rows` documents chosen by the hash of their key (twice as
    many at most), which is fitted on the driver by Newton steps; the prior comes from all labelled ones.
    """
    means = labels.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull()).groupBy(
        F.col(f"`{key}`").alias("key")).agg(F.avg(F.col(f"`{label}`").cast("double")).alias("good"))
    known = features.join(means, "key").select("key", "good", "bins")
    good, n = known.agg(F.sum(F.round(F.col("good") * UNIT).cast("bigint")), F.count("*")).head()
    prior = ((good or 0) / UNIT + 1) / (n + 2)
    steps = 1_000_000
    chosen = F.pmod(F.xxhash64("key"), F.lit(steps)) < int(steps * min(1.0, rows / max(n, 1)))
    sample = known.where(chosen).dropDuplicates(["key", "bins"]).limit(2 * rows).toPandas()
    sample = sample.assign(order=sample["bins"].map(tuple)).sort_values(["key", "order"])
    sizes = [len(edges) + 1 for edges in EDGES.values()]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    weights = np.zeros(starts[-1])
    if len(sample):
        x = np.zeros((len(sample), starts[-1]))
        columns = np.array(sample["bins"].tolist(), np.int64) + starts[:-1]
        np.put_along_axis(x, columns, 1.0, axis=1)
        weights = _newton(x, sample["good"].to_numpy(float), math.log(prior / (1 - prior)))
    table = tuple(tuple(round(float(w), 6) for w in weights[i:j]) for i, j in zip(starts[:-1], starts[1:]))
    return Evidence(table, prior)


def _newton(x: np.ndarray, y: np.ndarray, offset: float, penalty: float = PENALTY, steps: int = 25) -> np.ndarray:
    """Ridge-penalised logistic weights beside a fixed offset (the log odds of the prior)."""
    weights = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + offset, -30, 30)))
        slope = x.T @ (p - y) + penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _pseudo_count(groups: DataFrame, towards: str) -> float:
    """Prior strength by moments: the spread of the groups' rates beyond what chance gives."""
    n, s = F.col("n").cast("double"), F.col("s") / UNIT
    total, good, squares, spread, count = groups.agg(
        F.sum(n), F.sum(s), F.sum(n * n), F.sum(n * (s / n - F.col(towards)) ** 2), F.count("*")).head()
    if not total:
        return 1.0
    mean = min(max(good / total, 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean)
    between = (spread - (count - 1) * chance) / max(total - squares / total, 1.0)
    strength = chance / between - 1 if between > 0 else 1e6
    return float(round(min(max(strength, 1.0), 1e6), 3))


def _rates(features: DataFrame, evidence: Evidence) -> tuple[DataFrame, float]:
    """One row per host and path: n, s, host_rate, path_rate; and the paths' pseudo count."""
    own = F.round(probability(evidence.column() + math.log(evidence.good / (1 - evidence.good))) * UNIT).cast("bigint")
    paths = common.materialise(features.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(own).alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    whole = hosts.agg(F.sum("n"), F.sum("s")).head()
    world = whole[1] / UNIT / whole[0] if whole[0] else evidence.good
    strength = _pseudo_count(hosts.withColumn("to", F.lit(world)), "to")
    hosts = hosts.select(F.col("host").alias("of"),
                         ((F.col("s") / UNIT + strength * world) / (F.col("n") + strength)).alias("host_rate"))
    both = common.materialise(paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of"), "rates")
    return both, _pseudo_count(both, "host_rate")


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
           path: str = "lang", label: str = "quality", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """`row` (the document's own columns, or those of `keep`), evidence, host_rate, path_rate, posterior and kept.

    Texts are read once and never shuffled: rows and bins are written, and statistics and scores come from there.
    """
    columns = docs.columns if keep is None else keep
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{key}`").alias("key"),
                      F.col(f"`{host}`").alias("host"), F.col(f"`{path}`").alias("path"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    binned = _bins(own, "text").drop("text")
    features = common.materialise(binned.select("row", "key", "host", "path", "bins"), "features")
    evidence = fit(features, labels, key, label)
    rates, strength = _rates(features, evidence)
    rates = rates.withColumnsRenamed({"host": "of_host", "path": "of_path"})
    scored = features.withColumn("evidence", evidence.column()).join(
        rates, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    alone = F.round(probability(F.col("evidence") + math.log(evidence.good / (1 - evidence.good))) * UNIT).cast("bigint")
    path_rate = ((F.col("s") - alone) / UNIT + strength * F.col("host_rate")) / (F.col("n") - 1 + strength)
    bounded = F.least(F.greatest(path_rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    posterior = probability(F.col("evidence") + log_odds(bounded))
    return scored.select("row", F.round("evidence", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"),
                         F.round(bounded, 6).alias("path_rate"), F.round(posterior, 6).alias("posterior"),
                         (F.round(posterior, 6) >= threshold).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judged(docs, labels, **options).where("kept").select("row.*")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its evidence, its site's rates, the posterior and the decision."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judged(docs, common.table(spark, sf_dir, "labels"), keep=["doc_id"]).select(
        "row.doc_id", "evidence", "host_rate", "path_rate", "posterior", "kept")
