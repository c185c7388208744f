"""Benchmark decontamination: Wu-Manber search of all windows of benchmark items in whole documents.

The alphabet is words. A window is `WINDOW` consecutive words of an item, an item of fewer words is one window;
windows of one length share three tables. The shift table gives, for a block of two words, how far the
search may skip; where it gives none, the block ends some window, and the bucket of its hash (and of the
words before it) holds the windows to compare byte by byte. All texts of a slice, long ones in segments, are searched
side by side: each has a cursor that skips by its own shifts.

Items are not broadcast: they are written in chunks of bounded size in the shared folder, and each task takes
one chunk after another, so that a larger benchmark costs more passes over a slice in memory, never more memory.

Defined results: a null or empty text has no words and no hits. Items without words occur nowhere; an item without
an id is searched and its words are hit, but it is not counted or named. Items with the same id are one item, equal
items with different ids both count. Repeated rows are judged alike. Without items, or on an empty table, nothing is
hit. The documents' own columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscore.llm import byte_words, common, ragged, shingles, storage

WINDOW = 10
#: Words in a block of the shift table.
BLOCK = 2
#: Ends of windows that one cursor searches.
SEGMENT = 512
#: Bytes of items that a task holds at a time.
CHUNK_BYTES = 16 << 20
#: Bytes of documents at a time where there are several chunks of items.
WIDE_SLICE = 32 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _folded(keys: list[np.ndarray]) -> np.ndarray:
    found = keys[0]
    for more in keys[1:]:
        found = shingles.mixed(found * _ODD + more)
    return found


class Tables:
    """Shift table and buckets of the windows of one length, which begin at the words `first` of `runs`."""

    def __init__(self, runs: byte_words.Runs, first: np.ndarray, owner: np.ndarray, length: int):
        self.length, self.width = length, min(BLOCK, length)
        words = runs.keys(np.arange(len(runs)))

        def block(at: np.ndarray) -> np.ndarray:
            return _folded([words[at + k] for k in range(self.width)])

        bits = max(int(4 * len(first) * length).bit_length(), 12)
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, length - self.width + 1, np.int64)
        for offset in range(length - self.width + 1):  # the last to write is the nearest to the end
            self.shift[block(first + offset) & self.mask] = length - self.width - offset
        bucket = _folded([block(first + length - self.width), *(words[first + k] for k in range(length - self.width))])
        begin, size = runs.starts[first], runs.ends[first + length - 1] - runs.starts[first]
        order = np.lexsort((size, bucket))
        bucket, begin, size, owner = bucket[order], begin[order], size[order], owner[order]
        fresh = np.ones(len(order), bool)  # a window that differs from the one before it
        alike = (bucket[1:] == bucket[:-1]) & (size[1:] == size[:-1])
        pairs = np.flatnonzero(alike)
        fresh[1:][pairs] = ~byte_words.same_bytes(runs.data, begin[pairs + 1], runs.data, begin[pairs], size[pairs])
        #: Distinct windows by bucket, where they stand in the items, and the items that own each.
        self.bucket, self.begin, self.size = bucket[fresh], begin[fresh], size[fresh]
        self.data = runs.data
        window = np.cumsum(fresh) - 1
        owned = np.unique(np.stack((window, owner)), axis=1)
        self.owners = owned[1]
        self.owner_starts = np.searchsorted(owned[0], np.arange(len(self.bucket) + 1))

    def occurrences(self, text: byte_words.Runs) -> tuple[np.ndarray, np.ndarray]:
        """First word and window of every occurrence in the texts."""
        low, high = text.bounds[:-1] + self.length - 1, text.bounds[1:]
        pieces = np.maximum(-(-(high - low) // SEGMENT), 0)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cursor = np.repeat(low, pieces) + nth * SEGMENT
        stop = np.minimum(np.repeat(high, pieces), cursor + SEGMENT)
        ends = []
        while len(cursor):
            block = _folded([text.keys(cursor - self.width + 1 + k) for k in range(self.width)])
            skip = self.shift[block & self.mask]
            if not skip.all():
                none = skip == 0
                ends.append((cursor[none], block[none]))
            cursor = cursor + np.maximum(skip, 1)
            going = cursor < stop
            cursor, stop = cursor[going], stop[going]
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end = np.concatenate([e for e, _ in ends])
        first = end - self.length + 1
        sought = _folded([np.concatenate([b for _, b in ends]),
                          *(text.keys(first + k) for k in range(self.length - self.width))])
        low, high = np.searchsorted(self.bucket, sought), np.searchsorted(self.bucket, sought, "right")
        at, window = [], []
        size = text.ends[end] - text.starts[first]
        nth = 0
        while (more := np.flatnonzero(low + nth < high)).size:  # one round, unless two windows share a hash
            some, candidate = first[more], low[more] + nth
            fits = np.flatnonzero(size[more] == self.size[candidate])
            fits = fits[byte_words.same_bytes(text.data, text.starts[some[fits]], self.data, self.begin[candidate[fits]],
                                              size[more][fits])]
            at.append(some[fits]), window.append(candidate[fits])
            nth += 1
        return (np.concatenate(at), np.concatenate(window)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Items:
    """All windows of a chunk of items."""

    def __init__(self, ids: list[str | None], texts: pa.Array, window: int):
        runs = byte_words.words(texts)
        self.ids = ids
        counts = np.diff(runs.bounds)
        length = np.minimum(counts, window)
        n = np.where(counts > 0, counts - length + 1, 0)
        owner = np.repeat(np.arange(len(counts)), n)
        first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(runs.bounds[:-1], n)
        self.tables = [Tables(runs, first[length[owner] == k], owner[length[owner] == k], k)
                       for k in np.unique(length[owner]).tolist()]

    def search(self, text: byte_words.Runs, depth: np.ndarray) -> set[tuple[int, str]]:
        """Adds where hits begin (and ends, negative) to `depth`; the (text, item id) pairs found."""
        found: set[tuple[int, str]] = set()
        for table in self.tables:
            first, window = table.occurrences(text)
            np.add.at(depth, first, 1)
            np.add.at(depth, first + table.length, -1)
            doc = np.searchsorted(text.bounds, first, "right") - 1
            for t, w in np.unique(np.stack((doc, window)), axis=1).T.tolist():
                for owner in table.owners[table.owner_starts[w]:table.owner_starts[w + 1]].tolist():
                    if self.ids[owner] is not None:
                        found.add((t, self.ids[owner]))
        return found


@lru_cache(maxsize=1)
def _chunk(folder: str, number: int, window: int) -> Items:
    system, base = storage.opened(folder)
    rows = pq.read_table(f"{base}/chunk={number}", filesystem=system, columns=["id", "text"], partitioning=None)
    return Items(rows.column("id").to_pylist(), rows.column("text").combine_chunks(), window)


def _written(items: DataFrame, key: str, text: str) -> tuple[str, list[int]]:
    """The folder of the items in chunks of about CHUNK_BYTES, and the chunks' numbers."""
    own = items.select(F.col(f"`{key}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    total = own.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    folder = common.new_folder(items.sparkSession, "items")
    chunks = -(-total // CHUNK_BYTES)
    chunk = F.pmod(F.xxhash64("id", "text"), F.lit(max(chunks, 1))).cast("int")
    own.withColumn("chunk", chunk).repartition("chunk").write.partitionBy("chunk").parquet(folder)
    there = items.sparkSession.read.schema("id string, text string, chunk int").parquet(folder)
    return folder, sorted(r[0] for r in there.select("chunk").distinct().collect()) if total else []


def searched(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
             window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """`row` (the documents' columns, or those of `keep`), n_words, n_hit, items (ids as sorted strings) and spans.

    A span is a run of hit words: its first word, from 0, and the word after its last.
    """
    folder, chunks = _written(items, item_key, item_text)
    columns = docs.columns if keep is None else keep
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("text"))
    span = T.StructType([T.StructField("first", T.LongType()), T.StructField("after", T.LongType())])
    schema = T.StructType([
        own.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(span))])
    room = ragged.SLICE_BYTES if len(chunks) <= 1 else WIDE_SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text", room):
                runs = byte_words.words(part.column("text"))
                depth = np.zeros(len(runs) + 1, np.int64)
                found: set[tuple[int, str]] = set()
                for number in chunks:
                    found |= _chunk(folder, number, window).search(runs, depth)
                yield _result(part.column("row"), runs, depth, found)

    return own.mapInArrow(run, schema)


def _result(rows: pa.Array, runs: byte_words.Runs, depth: np.ndarray, found: set[tuple[int, str]]) -> pa.RecordBatch:
    hit = np.cumsum(depth[:-1]) > 0
    counted = np.concatenate(([0], np.cumsum(hit)))
    n = len(runs.bounds) - 1
    names: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    for t, name in sorted(found):
        names[t].append(name)
    marks = counted[runs.bounds[1:]] - counted[runs.bounds[:-1]]
    for t in np.flatnonzero(marks).tolist():
        own = np.concatenate(([False], hit[runs.bounds[t]:runs.bounds[t + 1]], [False]))
        edges = np.flatnonzero(own[1:] != own[:-1]).tolist()
        spans[t] = [{"first": a, "after": b} for a, b in zip(edges[0::2], edges[1::2])]
    span = pa.struct([("first", pa.int64()), ("after", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(np.diff(runs.bounds), pa.int64()), pa.array(marks, pa.int64()),
         pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(span))],
        names=["row", "n_words", "n_hit", "items", "spans"])


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with their own columns."""
    return searched(docs, items, **options).where("n_hit = 0").select("row.*")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hit words and the items of `benchmark` found in it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = searched(docs, common.table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n,
         array_to_string(list_slice(w, j, j + least(len(w), {WINDOW}) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), {WINDOW}) + 1)) AS j FROM i WHERE len(w) > 0)),
dw AS (
  SELECT k, j, n, array_to_string(list_slice(w, j, j + n - 1), ' ') AS win
  FROM (SELECT k, w, n, unnest(generate_series(1, len(w) - n + 1)) AS j FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
occ AS (SELECT dw.k, dw.j, dw.n, iw.item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hit AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(j, j + n - 1)) AS p FROM occ) GROUP BY k),
found AS (
  SELECT k, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS id FROM occ WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (k) LEFT JOIN found USING (k)
"""
