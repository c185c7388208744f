"""Near duplicates: MinHash bands propose, odd sketches estimate, full shingle sets confirm.

1. Each text gets a MinHash signature of BANDS x ROWS samples. A band's samples make one key. The
   samples are also folded into a bitmap of parities (odd sketch), one flipped bit a sample.
2. Equal sets are one class with the smallest id as node, so copies cost nothing further on.
3. Every member of a bucket is compared with the bucket's smallest node, and the components of the
   confirmed links are contracted. Buckets that lie in one component are done, which ends most groups
   of copies. For the nodes of the others it is counted how many of their shingles no other such node
   has. Nodes with too many of these can have no link; the rest are compared with the node of their
   bucket that has fewest, and contracted again. Members that are still in different components are
   compared pair by pair, by that count and by odd sketches of their whole sets, which rule out only
   pairs that cannot be links.
4. A pair is compared by the population count of the XOR of its sketches, then by its full sets.

At the threshold of 0.8 a pair shares a band with probability 1 - (1 - 0.8^5)^48 = 1 - 5e-9; the sketch limit
lies five standard deviations above the count expected there. Shingles are 64-bit hashes.

Defined results: a null or empty text has an empty set and no links. Rows without an id have no
links and no component; they are kept. Rows with the same id are one document, so their texts are
linked. Repeated rows share their component. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common, ragged, shingles
from crawlscore.llm.components import components

ROWS, BANDS = 5, 48
SKETCH_BITS = 512
#: XOR bits up to which a pair goes on: 80 are expected at similarity 0.8, with a deviation of 12.
SKETCH_LIMIT = 146
#: Bands and limit are fitted to this similarity; pairs below it would be missed.
LEAST_PERCENT = 80
#: Node lists of up to this many rows (16 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Places of the parities of whole sets, of which only nodes in open buckets have one.
PARITY_BITS = 1024
_CHUNK = 256


def _samplers() -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and masks; h -> (h ^ mask) * multiplier permutes the 32-bit numbers."""
    seeds = shingles.mixed(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64))
    multipliers, masks = seeds[::2].astype(np.uint32) | np.uint32(1), (seeds[1::2] >> np.uint64(32)).astype(np.uint32)
    return multipliers, masks


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples (one row a set); all ones for an empty set."""
    multipliers, masks = _samplers()
    out = np.full((len(sets), ROWS * BANDS), 0xFFFFFFFF, np.uint32)
    for row, hashes in enumerate(sets):
        high = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
        for start in range(0, len(high), _CHUNK):
            values = high[start:start + _CHUNK] ^ masks
            values *= multipliers
            np.minimum(out[row], values.min(axis=0), out=out[row])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different from band to band."""
    parts = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = shingles.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities for each row of samples, packed into 64-bit words."""
    rows, size = samples.shape
    spread = shingles.mixed(samples.astype(np.uint64) + (np.arange(size, dtype=np.uint64) << np.uint64(32)))
    place = (spread % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(rows)[:, None] * SKETCH_BITS
    parity = np.bincount(place.ravel(), minlength=rows * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(rows, SKETCH_BITS), axis=1).view(np.int64)


_PRINTS = "key bigint, n bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>"


def _list_array(values: np.ndarray) -> pa.Array:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1).view(np.int64)))


def fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per row with an id: set size, digest of the set, band keys and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                found = list(shingles.sets(part.column("text"), width))
                samples = signatures(found)
                again = [shingles.mixed(x) for x in found]
                d1 = np.array([np.add.reduce(x, dtype=np.uint64) for x in again], np.uint64)
                d2 = np.array([np.bitwise_xor.reduce(shingles.mixed(x)) for x in again], np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([len(x) for x in found], pa.int64()),
                     pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                     _list_array(band_keys(samples)), _list_array(odd_sketches(samples))],
                    names=["key", "n", "d1", "d2", "bands", "sketch"])

    return docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, _PRINTS)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Odd sketch of a whole set: the parity of the number of hashes at each of PARITY_BITS places."""
    odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, n, parity, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                found = list(shingles.sets(part.column("text"), width))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate(found).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([len(x) for x in found], pa.int64()),
                     _list_array(np.array([parities(x) for x in found])),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["node", "n", "parity", "shingles"])

    return texts.mapInArrow(run, "node bigint, n bigint, parity array<bigint>, shingles array<bigint>")


def _xor_bits(left: str, right: str, bits: int) -> Column:
    words = [F.bit_count(F.col(left)[k].bitwiseXOR(F.col(right)[k])) for k in range(bits // 64)]
    return sum(words[1:], words[0])


def _may_match(a: str, b: str, percent: int) -> Column:
    """Set sizes and sketches allow the similarity."""
    return (F.least(f"{a}.n", f"{b}.n") * 100 >= F.greatest(f"{a}.n", f"{b}.n") * percent) & (
        _xor_bits(f"{a}.sketch", f"{b}.sketch", SKETCH_BITS) <= SKETCH_LIMIT)


def _can_match(a: str, b: str, percent: int) -> Column:
    """Parities of the whole sets allow the similarity; never false for a link.

    Their XOR has no more bits than the sets differ in, and a link of similarity s allows
    (|A| + |B|) (1 - s) / (1 + s) differences.
    """
    bits = _xor_bits(f"{a}.parity", f"{b}.parity", PARITY_BITS)
    return bits * (100 + percent) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (100 - percent)


class _Corpus:
    """The written tables of one run."""

    def __init__(self, docs: DataFrame, key: str, text: str, width: int, percent: int):
        self.width, self.percent = width, percent
        self.texts = docs.select(F.col(f"`{key}`").cast("bigint").alias("node"), F.col(f"`{text}`").alias("text"))
        self.prints = common.materialise(fingerprints(docs, key, text, width), "fingerprints")
        known = self.prints.where("key IS NOT NULL AND n > 0")
        self.classes = common.materialise(known.groupBy("n", "d1", "d2").agg(F.min("key").alias("node")), "classes")
        self.nodes = common.materialise(
            known.join(self.classes.selectExpr("node AS key", "d1", "d2"), ["key", "d1", "d2"], "left_semi")
            .selectExpr("key AS node", "n", "bands", "sketch"), "nodes")
        # a document whose rows hold several texts links their classes
        of_key = known.select("key", "n", "d1", "d2").join(self.classes, ["n", "d1", "d2"])
        self.same_id = of_key.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("a", "b")

    def members(self) -> DataFrame:
        """Rows (band, node, hub) of the buckets that hold more than one node."""
        each = self.nodes.select("node", F.explode("bands").alias("band"))
        hubs = each.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
        return common.materialise(each.join(hubs.select("band", "hub"), "band"), "buckets")

    def links(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough; sketches first."""
        sketches = self.nodes.select("node", "n", "sketch")
        a, b = sketches.alias("a"), sketches.alias("b")
        near = common.materialise(
            pairs.alias("p").join(a, F.col("p.a") == F.col("a.node")).join(b, F.col("p.b") == F.col("b.node"))
            .where(_may_match("a", "b", self.percent)).select("p.a", "p.b").distinct(), "near-pairs")
        if sets is None:
            sets = self.sets(near.selectExpr("a AS node").union(near.selectExpr("b AS node")).distinct())
        return self.confirmed(near, sets)

    def sets(self, nodes: DataFrame) -> DataFrame:
        """(node, shingles) of the given nodes, read from their texts once more."""
        asked = common.materialise(nodes, "asked")
        few = asked.count() <= BROADCAST_ROWS
        texts = self.texts.join(F.broadcast(asked) if few else asked, "node", "left_semi")
        return common.materialise(_shingle_sets(texts, self.width).dropDuplicates(), "sets")

    def confirmed(self, near: DataFrame, sets: DataFrame) -> DataFrame:
        both = (near.join(sets.selectExpr("node AS a", "shingles AS x"), "a")
                .join(sets.selectExpr("node AS b", "shingles AS y"), "b"))
        counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).cast("bigint").alias("shared"),
                              (F.size("x") + F.size("y")).cast("bigint").alias("together"))
        sure = counted.where(100 * F.col("shared") >= self.percent * (F.col("together") - F.col("shared")))
        return common.materialise(sure.select("a", "b").distinct(), "links")


def _open(placed: DataFrame) -> DataFrame:
    """Rows (band, node, label, ...) of the buckets that hold more than one component."""
    mixed = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return placed.join(mixed.select("band"), "band")


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _with_own(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds `own`: how many shingles no other open node has (0 where a node has several sets).

    A link cannot use these, so |A and B| <= min(|A| - own(A), |B| - own(B)) for open nodes A and B.
    """
    alone = (sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle")
             .agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1"))
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    several = sets.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node")
    return (open_.join(own.join(several, "node", "left_anti"), "node", "left")
            .withColumn("own", F.coalesce("own", F.lit(0))))


def linked(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row of `docs`."""
    if percent < LEAST_PERCENT:
        raise ValueError(f"bands and sketches find no pairs below {LEAST_PERCENT} percent reliably, got {percent}")
    corpus = _Corpus(docs, key, text, width, percent)
    members = corpus.members()
    stars = members.where("node <> hub").selectExpr("hub AS a", "node AS b").distinct()
    links = corpus.links(stars).union(corpus.same_id)
    # stars around the least changed node of each bucket that is still open
    open_ = common.materialise(_open(_placed(members.select("band", "node"), components(links))), "open-buckets")
    sets = corpus.sets(open_.select("node").distinct())
    counted = _with_own(open_.join(sets.select("node", "n", "parity"), "node"), sets)
    able = common.materialise(counted.where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "able")
    central = able.groupBy("band").agg(F.min(F.struct("own", "node", "label")).alias("hub"))
    spokes = able.join(central, "band").where("label <> hub.label").selectExpr(
        "least(node, hub.node) AS a", "greatest(node, hub.node) AS b").distinct()
    links = links.union(corpus.links(spokes, sets))
    # what is left: pairs of different components within a bucket
    rest = common.materialise(_open(_placed(able.drop("label"), components(links))), "open-buckets")
    a, b = rest.alias("a"), rest.alias("b")
    shared = F.least(F.col("a.n") - F.col("a.own"), F.col("b.n") - F.col("b.own"))
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.node") < F.col("b.node"))
                  & (F.col("a.label") != F.col("b.label")) & _can_match("a", "b", percent)
                  & (100 * shared >= percent * (F.col("a.n") + F.col("b.n") - shared)))
    near = common.materialise(near.selectExpr("a.node AS a", "b.node AS b").distinct(), "near-pairs")
    labels = components(links.union(corpus.confirmed(near, sets)))
    groups = (corpus.classes.join(labels, "node", "left")
              .select("n", "d1", "d2", F.coalesce("label", "node").alias("component_id")))
    rows = corpus.prints.select("key", "n", "d1", "d2").join(groups, ["n", "d1", "d2"], "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key"))
    return rows.select("key", F.col("n").alias("n_shingles"), component.alias("component_id"),
                       F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents with one of each group left, by its own columns.

    Of rows with the same id one stays: that whose JSON form has the smallest SHA-256, so reruns agree.
    Rows without an id all stay. Only rows that share an id meet in a shuffle with their texts. The ids to leave out are broadcast
    up to BROADCAST_ROWS; beyond that Spark joins them as it sees fit.
    """
    found = linked(docs, key, **options).where("key IS NOT NULL").groupBy("key").agg(
        F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    out = common.materialise(found.where("NOT kept OR n > 1"), "left-out")
    few = out.count() <= BROADCAST_ROWS

    def keys(condition: str) -> DataFrame:
        chosen = out.where(condition).select(F.col("key").alias(key))
        return F.broadcast(chosen) if few else chosen

    once = docs.join(keys("true"), key, "left_anti")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = docs.join(keys("kept"), key, "left_semi").select(whole.alias("row"))
    again = again.groupBy(F.col(f"row.`{key}`")).agg(
        F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")).select("row.*")
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents on 4-word shingles at a similarity of 0.8."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked(docs, width=4).withColumnRenamed("key", "doc_id")


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x
  FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r AS (SELECT doc_id AS i, doc_id AS j FROM n UNION SELECT r.i, l.b FROM r JOIN l ON l.a = r.j),
m AS (SELECT i, min(j) AS first FROM r GROUP BY i)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.first, d.doc_id) AS component_id,
       coalesce(m.first, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.i = d.doc_id
"""
