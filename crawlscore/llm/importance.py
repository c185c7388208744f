"""Target-distribution importance resampling: documents drawn by how much their n-grams resemble a target's.

Features are runs of one to three words, hashed into buckets. One pass counts the buckets of all documents and of the
target; the logarithm of the smoothed ratio is a bucket's gain. A second pass scores each document with the array of gains,
and a Gumbel number from its id's hash makes the highest scores a sample. The cutoff is found by bisection: exact
counts over the written scores, three halvings a job, then over the ids that tie at the cutoff. Only the drawn rows are
dealt out by range and ranked.

Only the gains, an array of `BUCKETS` numbers whatever the input, pass the driver, and the bisection's counts.

Defined results: a null or empty text has no features and weight 0. The id is an integer; a null one hashes as an empty
text and loses ties. Rows with the same id and score tie by the order in which they were read. Documents
with fewer than `LEAST_WORDS` words are scored but never drawn. An empty target gives every bucket the gain of its rarity; an empty
table gives no rows. The documents' own columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscore.llm import byte_words, common, crc, ragged

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42"
_NO_KEY = (1 << 63) - 1


def buckets(runs: byte_words.Runs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length the places of the n-grams' first words, and their buckets."""
    if not len(runs):
        return
    codes, distinct = ragged.coded(runs.packed())
    sizes = runs.ends - runs.starts
    own = crc.of_each(distinct)
    space = np.full(len(own), 0xE96CCF45, np.uint32)  # the checksum of one space
    spaced = crc.joined(space, own, np.diff(np.frombuffer(distinct.buffers()[1], np.int64)[:len(own) + 1]))
    after, now = spaced[codes], own[codes]
    doc = np.repeat(np.arange(len(runs.bounds) - 1), np.diff(runs.bounds))
    places = np.arange(len(codes))
    yield places, now % np.uint32(BUCKETS)
    for n in range(2, LONGEST + 1):
        fits = np.flatnonzero(places + n - 1 < len(doc))
        fits = fits[doc[places[fits]] == doc[places[fits] + n - 1]]
        places, now = places[fits], now[fits]
        last = places + n - 1
        now = crc.joined(now, after[last], sizes[last] + 1)
        yield places, now % np.uint32(BUCKETS)


def bucket_counts(texts: DataFrame, text: str, into: str) -> DataFrame:
    """(bucket, count) of all features, added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                for _, found in buckets(byte_words.words(part.column("text"))):
                    total += np.bincount(found, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text}`").alias("text")).where("text <> ''").mapInArrow(run, "bucket bigint, n bigint")
    return rows.groupBy("bucket").agg(F.sum("n").alias(into))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text") -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) by bucket."""
    spark = docs.sparkSession
    both = spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(
        bucket_counts(docs, text, "s"), "bucket", "left").join(bucket_counts(target, target_text, "t"), "bucket", "left").fillna(0)
    both = common.materialise(both, "bucket-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).head()
    ratio = (F.col("t") + 1.0) * float(all_s + BUCKETS) / ((F.col("s") + 1.0) * float(all_t + BUCKETS))
    rows = both.select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, gain in rows:
        out[bucket] = gain
    return out


def noise(key: Column, seed: str = SEED) -> Column:
    """floor(1000 g) of a Gumbel number g from 32 bits of the key's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
           seed: str = SEED, keep: list[str] | None = None) -> DataFrame:
    """`row` (the documents' columns, or those of `keep`), key, nth, n_words, n_features, weight and score, as a written table."""
    gain = gains(docs, target, text, target_text)
    columns = docs.columns if keep is None else keep
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{key}`").cast("bigint").alias("key"),
                      F.col(f"`{text}`").alias("text"))
    schema = T.StructType([own.schema["row"], own.schema["key"], *(
        T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                runs = byte_words.words(part.column("text"))
                sums = np.zeros(len(runs) + 1, np.int64)
                counts = np.diff(runs.bounds)
                for places, found in buckets(runs):
                    sums[places + 1] += gain[found]
                sums = np.cumsum(sums)
                features = sum(np.maximum(counts - n, 0) for n in range(LONGEST))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("key"), pa.array(counts, pa.int64()), pa.array(features, pa.int64()),
                     pa.array(sums[runs.bounds[1:]] - sums[runs.bounds[:-1]])],
                    names=["row", "key", "n_words", "n_features", "weight"])

    rows = own.mapInArrow(run, schema).withColumn("score", F.col("weight") + noise(F.col("key"), seed))
    return common.materialise(rows.withColumn("nth", F.monotonically_increasing_id()), "importance-scores")


def highest(rows: DataFrame, value: str, need: int) -> tuple[int, int]:
    """The largest number v such that at least `need` rows have `value` >= v, and how many have more than v.

    Each job counts exactly, at seven numbers: three halvings of what is left.
    """
    low, top = rows.agg(F.min(value), F.max(value)).head()
    high, above = top + 1, 0  # at least `need` rows from `low` on, fewer from `high` on
    while high - low > 1:
        points = sorted({low + (high - low) * k // 8 for k in range(1, 8)} - {low})
        counts = rows.agg(*[F.count_if(F.col(value) >= F.lit(p)).alias(f"c{k}") for k, p in enumerate(points)]).head()
        for point, count in zip(points, counts):
            if count < need:
                high, above = point, count
                break
            low = point
    return low, above


def drawn(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Scored rows with `rank`: 1, 2, 3... for the drawn ones by score, key and place, null for all others."""
    able = rows.where(F.col("n_words") >= least_words)
    need = able.count() * percent // 100
    if not need:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    tied = able.withColumns({"low_key": -1 - F.coalesce("key", F.lit(_NO_KEY)), "low_nth": -F.col("nth")})
    chosen = F.lit(False)
    same = F.col("n_words") >= least_words
    for value, column in (("score", F.col("score")), ("low_key", -1 - F.coalesce("key", F.lit(_NO_KEY))), ("low_nth", -F.col("nth"))):
        cut, above = highest(tied, value, need)
        chosen = chosen | (same & (column > F.lit(cut)))
        same, need = same & (column == F.lit(cut)), need - above
        tied = tied.where(F.col(value) == F.lit(cut))
        if tied.count() == need:
            break
    marked = rows.withColumn("drawn", chosen | same)
    ranked = common.numbered(
        marked.where("drawn").withColumn("falling", -F.col("score")), ["falling", "key", "nth"], "rank")
    return (ranked.withColumn("rank", (F.col("rank") + 1).cast("bigint")).drop("falling", "drawn")
            .unionByName(marked.where("NOT drawn").withColumn("rank", F.lit(None).cast("bigint")).drop("drawn")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, **options) -> DataFrame:
    """The drawn documents with their own columns."""
    return drawn(scored(docs, target, **options), percent, least_words).where("rank IS NOT NULL").select("row.*")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its features, weight and score, and its rank among the drawn ones."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = drawn(scored(docs, common.table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return rows.select("row.doc_id", "n_features", "weight", "score", "rank")


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT {_WORDS} AS w FROM benchmark),
df AS (SELECT k, array_to_string(list_slice(w, j, j + n - 1), ' ') AS g
       FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d, range(1, {LONGEST + 1}) AS r(n) WHERE len(w) >= n)),
tf AS (SELECT array_to_string(list_slice(w, j, j + n - 1), ' ') AS g
       FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM i, range(1, {LONGEST + 1}) AS r(n) WHERE len(w) >= n)),
dc AS (SELECT k, g, count(*) AS c FROM df GROUP BY k, g),
grams AS (SELECT g, {crc.crc32_sql('g')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT g FROM (SELECT g FROM dc UNION ALL SELECT g FROM tf))),
s AS (SELECT bucket, sum(c) AS s FROM dc JOIN grams USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tf JOIN grams USING (g) GROUP BY bucket),
b AS (SELECT r.bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range({BUCKETS}) AS r(bucket)
      LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
gain AS (
  SELECT bucket, CAST(floor(1000::DOUBLE * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain
  FROM b),
w AS (SELECT k, sum(c) AS n_features, sum(c * gain) AS weight FROM dc JOIN grams USING (g) JOIN gain USING (bucket) GROUP BY k),
sc AS (
  SELECT k, doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000::DOUBLE * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
              AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (k)),
r AS (SELECT *, n_words >= {LEAST_WORDS} AS able, row_number() OVER (PARTITION BY n_words >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, k) AS n,
             count(*) FILTER (WHERE n_words >= {LEAST_WORDS}) OVER () AS n_able FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND n <= {PERCENT} * n_able // 100 THEN n END AS rank FROM r
"""
