"""Exact top-k inner products by Fagin's threshold algorithm over sorted lists of each dimension.

Vectors are cut into blocks; each block has its rows' order by every dimension. For a query the lists are
read from their favourable ends in rounds of doubling depth. Rows met for the first time are scored in
full; no other row can score more than the sum of what each list would still give, and a block is
done once that bound is below its kth score. Equal bounds go on, since ties go to smaller ids.

Every block of queries meets every block of vectors: queries are copied once for each partition of the
blocks and equi-joined on it. The best of each block go to one ranking per query, k rows a block.

Defined results: vectors that are null or hold null or non-finite components, and rows without an id,
take no part. Rows with the same id count once, with the smallest vector. A query never meets its own id.
Shorter vectors count as if filled up with zeros. Scores beyond 64 bits end at its limits. Empty
tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscore.llm import common

SCALE = 256
BLOCK, QUERIES = 4_096, 256
FIRST_DEPTH = 16
_BLOCKS = "part int, nth int, n int, width int, ids binary, vectors binary, sorted binary"


def usable(rows: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v): whole components floor(scale * x) as doubles, one row for each id."""
    own = rows.select(F.col(f"`{key}`").cast("bigint").alias("id"),
                      F.transform(F.col(f"`{vector}`"), lambda x: F.lit(float(scale)) * x.cast("double")).alias("x"))
    own = own.where("id IS NOT NULL AND x IS NOT NULL AND forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('Infinity'))")
    return own.groupBy("id").agg(F.min("x").alias("x"))


def _packed(ids: np.ndarray, vectors: np.ndarray, part: int, nth: int, lists: bool) -> list:
    small = np.abs(vectors).max(initial=0) < 32_768
    order = np.argsort(vectors, axis=0, kind="stable").astype("<i4").tobytes() if lists else b""
    body = (b"s" if small else b"d") + vectors.astype("<i2" if small else "<f8").tobytes()
    return [part, nth, len(ids), vectors.shape[1], ids.astype("<i8").tobytes(), body, order]


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    kind = "<i2" if row["vectors"][:1] == b"s" else "<f8"
    vectors = np.frombuffer(row["vectors"], kind, offset=1).reshape(row["n"], row["width"]).astype(np.float64)
    return np.frombuffer(row["ids"], "<i8"), vectors


def blocks(vectors: DataFrame, size: int, lists: bool) -> DataFrame:
    """Rows packed into blocks of at most `size`, with the order of each dimension if `lists`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                piece = batch.slice(start, size)
                rows = [np.floor(np.asarray(v, np.float64)) for v in piece.column("x").to_pylist()]
                width = max(map(len, rows))
                matrix = np.zeros((len(rows), width))
                for k, row in enumerate(rows):
                    matrix[k, :len(row)] = row
                ids = piece.column("id").to_numpy()
                values = _packed(ids, matrix, part, nth, lists)
                nth += 1
                kinds = [pa.int32()] * 4 + [pa.binary()] * 3
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)],
                                                 names=["part", "nth", "n", "width", "ids", "vectors", "sorted"])

    return common.materialise(vectors.mapInArrow(run, _BLOCKS), "blocks")


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where these are exact, else in Python's integers."""
    largest = np.abs(vectors).max(initial=0) * np.abs(query).max(initial=0) * max(len(query), 1)
    if largest < 2.0 ** 53:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query]
    sums = [sum(int(x) * y for x, y in zip(row, whole)) for row in vectors.tolist()]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


def best(ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[list[int], list[int]]:
    """Ids and scores of the block's k best rows for one query, by the threshold algorithm."""
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    seen = ids == own
    left = n - int(seen.sum())
    found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    depth, step = 0, FIRST_DEPTH
    while left:
        stop = min(depth + step, n)
        if len(up) or len(down):
            rows = np.concatenate((order[n - stop:n - depth, up].ravel(), order[depth:stop, down].ravel()))
        else:
            rows, stop = np.arange(n), n  # a query of zeros: every row scores 0
        rows = np.unique(rows[~seen[rows]])
        seen[rows] = True
        left -= len(rows)
        found_ids = np.concatenate((found_ids, ids[rows]))
        found = np.concatenate((found, scores(vectors[rows], query)))
        keep = np.lexsort((found_ids, -found))[:k]
        found_ids, found = found_ids[keep], found[keep]
        if stop == n:
            break
        bound = sum(int(query[d]) * int(vectors[order[n - 1 - stop, d], d]) for d in up) + sum(
            int(query[d]) * int(vectors[order[stop, d], d]) for d in down)
        if len(found) == k and bound < found[-1]:
            break
        depth, step = stop, step * 2
    return found_ids.tolist(), found.tolist()


def search(candidates: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding",
           scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query."""
    lists = blocks(usable(candidates, key, vector, scale), BLOCK, True)
    asked = blocks(usable(queries, key, vector, scale), QUERIES, False)
    parts = lists.agg(F.max("part")).head()[0]
    copies = asked.selectExpr("n AS q_n", "width AS q_width", "ids AS q_ids", "vectors AS q_vectors").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.lit(parts if parts is not None else 0))))
    pairs = lists.join(copies, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                ids, vectors = _unpacked(row)
                order = np.frombuffer(row["sorted"], "<i4").reshape(row["n"], row["width"])
                q_ids, q_vectors = _unpacked({"n": row["q_n"], "width": row["q_width"], "ids": row["q_ids"], "vectors": row["q_vectors"]})
                width = min(row["width"], row["q_width"])
                out: tuple[list[int], list[int], list[int]] = ([], [], [])
                for own, query in zip(q_ids.tolist(), q_vectors):
                    near, score = best(ids, vectors[:, :width], order[:, :width], own, query[:width], k)
                    out[0].extend([own] * len(near)), out[1].extend(near), out[2].extend(score)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    local = pairs.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def op8_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every row whose id is divisible by 50."""
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(rows, rows.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
