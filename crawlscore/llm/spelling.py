"""Spelling variants: words that differ by one code point are found in a trie of letter-group counts.

A word is arranged by its length and, level by level, by how often it has letters of each group. An edit moves at most one
count up (surplus) and one down (deficit), so a depth-first search follows, at each level, the counts that the rest of
a budget of one each allows; words of a leaf are verified letter by letter.

The upper levels of the trie are the cells by which Spark deals words out: a word stands in one cell and searches, as
copies that carry the rest of their budget, the few cells in reach. As many levels are used as keep the largest cell
within `CELL_WORDS`; a cell that is larger at any depth (words of the same letters) is dealt out in blocks, and its searches
go to all of them. A task holds one such cell or block at a time. Each pair is found from one side only: by the
shorter word, or the one in the lower cell, or the lesser word of a cell.

Defined results: null and empty texts have no words. A null id counts as an empty text in the hash. Repeated rows count anew.
Words are runs of A-Z, a-z and U+00C0 to U+00FF, other words given to `variants` are an error; null words are ignored, and
equal words given twice are one, with their counts added. Of near words of equal count the first in code-point
order is the form. Empty tables give no rows. Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import byte_words, common, crc, ragged

LEAST_LETTERS = 7
LEAST_COUNT = 2
TIMES = 10
SLIP = 31
#: Letters of each level of the trie; all others are counted by the last two levels, in turn.
GROUPS = ("e", "a", "i", "n", "o", "r", "t", "s", "l", "u", "h", "d", "cq", "mwy", "pbk", "gfvjxz")
LEVELS = len(GROUPS) + 2
#: Words that a task searches at a time.
CELL_WORDS = 50_000
#: Rows that are searched together.
CHUNK_ROWS = 100_000
#: Places of the trie that are followed together, and words that are verified rather than divided further.
FRONT = 1 << 16
LEAF = 3
#: Distinct words a task counts before it hands them on.
COUNTED = 300_000


def _levels_of_bytes() -> np.ndarray:
    out = len(GROUPS) + (np.arange(256) & 1)
    for level, group in enumerate(GROUPS):
        out[list(group.encode())] = level
    return out


_LEVEL = _levels_of_bytes()


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = SLIP, least_letters: int = LEAST_LETTERS,
                least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all documents, as a written table. Runs whose hash `slip` divides lose one letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                _count(counts, part.column("key"), part.column("text"), slip, least_letters)
                if len(counts) > COUNTED:
                    yield _counted(counts)
                    counts.clear()
        yield _counted(counts)

    own = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text")).where("text <> ''")
    parts = own.mapInArrow(run, "word string, n bigint")
    return common.materialise(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")


def _counted(counts: Counter[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])


def _count(counts: Counter[bytes], ids: pa.Array, texts: pa.Array, slip: int, least: int) -> None:
    runs = byte_words.letters(texts)
    if not len(runs):
        return
    codes, distinct = ragged.coded(runs.packed())
    words = distinct.to_pylist()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    long = np.flatnonzero(sizes[codes] >= least)
    codes, doc = codes[long], np.searchsorted(runs.bounds, long, "right") - 1
    utf8 = [w.decode("latin-1").encode() for w in words]
    octets = np.fromiter(map(len, utf8), np.int64, len(utf8))
    own = np.fromiter(map(zlib.crc32, utf8), np.uint32, len(utf8))
    ahead = np.fromiter((zlib.crc32(f"{i or ''}:".encode()) for i in ids.to_pylist()), np.uint32, len(ids))
    hashes = crc.joined(ahead[doc], own[codes], octets[codes])
    slips = hashes % np.uint32(slip) == 0
    whole = np.bincount(codes[~slips], minlength=len(words))
    for code in np.flatnonzero(whole).tolist():
        counts[words[code]] += int(whole[code])
    for code, h in zip(codes[slips].tolist(), hashes[slips].tolist()):
        word = words[code]
        if len(word) > least:
            at = h % len(word)
            counts[word[:at] + word[at + 1:]] += 1


def _vectors(words: pa.Array) -> tuple[byte_words.Runs, np.ndarray]:
    """The words as Latin-1 runs, and how often each has letters of each group."""
    runs = byte_words.letters(words)
    if len(runs) != len(words):
        raise ValueError("words must be runs of A-Z, a-z and U+00C0 to U+00FF")
    size = runs.ends - runs.starts
    letters = runs.data[:-8]
    kept = letters != 32
    at = np.repeat(np.arange(len(size)), size) * LEVELS + _LEVEL[letters[kept]]
    return runs, np.bincount(at, minlength=len(size) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def _cells(size: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Cell names: length and counts as big-endian numbers, so that they sort as the counts do."""
    both = np.ascontiguousarray(np.concatenate((size[:, None], counts), axis=1).astype(">i4"))
    offsets = np.arange(len(both) + 1, dtype=np.int64) * both.shape[1] * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both), [None, pa.py_buffer(offsets), pa.py_buffer(both)]).cast(pa.binary())


def _moves(levels: int) -> list[tuple[int, np.ndarray]]:
    """What a search may change on the way to another cell: letters more, and the change of each upper count."""
    none = np.zeros(levels, np.int32)
    one = np.eye(levels, dtype=np.int32)
    same = [none, *one, *-one, *(a - b for j, a in enumerate(one) for k, b in enumerate(one) if j != k)]
    lower = [m for m in same if tuple(m) >= tuple(none)]  # the other half is found from the other side
    return [(0, m) for m in lower] + [(1, m) for m in (none, *one)]


_ROWS = "cell binary, kind int, word string, n bigint, surplus int, deficit int"


def placed(words: DataFrame, levels: int) -> DataFrame:
    """Each word in its cell (kind 0), and its searches in the cells in reach (kind 1) with the rest of their budgets."""
    moves = _moves(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, vectors = _vectors(batch.column("word"))
            size, top = runs.ends - runs.starts, vectors[:, :levels]
            n = len(size)

            def rows(kept: np.ndarray, kind: int, longer: int, move: np.ndarray, surplus: int, deficit: int) -> pa.RecordBatch:
                some = batch.take(pa.array(kept))
                width = len(kept)
                return pa.RecordBatch.from_arrays(
                    [_cells(size[kept] + longer, top[kept] + move), pa.array(np.full(width, kind, np.int32)), some.column("word"),
                     some.column("n"), pa.array(np.full(width, surplus, np.int32)), pa.array(np.full(width, deficit, np.int32))],
                    names=["cell", "kind", "word", "n", "surplus", "deficit"])

            yield rows(np.arange(n), 0, 0, moves[0][1], 0, 0)
            for longer, move in moves:
                there = np.flatnonzero((top + move >= 0).all(axis=1))
                yield rows(there, 1, longer, move, 1 - int(move.max(initial=0)), 1 - longer + int(move.min(initial=0)))

    return words.select("word", "n").mapInArrow(run, _ROWS)


class Trie:
    """Words (rows of `vectors`) sorted by group and counts; a node of a level is a run of them."""

    def __init__(self, group: np.ndarray, vectors: np.ndarray):
        self.order = np.lexsort((*vectors.T[::-1], group))
        self.base = int(vectors.max(initial=0)) + 3
        self.groups = np.unique(group)
        self.starts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        n = len(group)
        changed = np.zeros(n, bool)
        parent = np.zeros(n, np.int64)
        for level, column in enumerate([group, *vectors.T]):
            column = column[self.order]
            changed = changed.copy()
            changed[:1] = True
            changed[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(changed)
            if level:
                self.keys.append(parent[starts] * self.base + column[starts])
            parent = np.cumsum(changed) - 1
            self.starts.append(np.append(starts, n))

    def search(self, group: np.ndarray, vectors: np.ndarray, surplus: np.ndarray,
               deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, word) rows within the budgets, in blocks; words of a small node come unchecked."""
        root = np.searchsorted(self.groups, group)
        there = root < len(self.groups)
        there[there] = self.groups[root[there]] == group[there]
        query = np.flatnonzero(there)
        stack = [(0, query, root[query], surplus[query], deficit[query])]
        while stack:
            level, query, node, up, down = stack.pop()
            if len(query) > FRONT:
                half = len(query) // 2
                stack.append((level, query[half:], node[half:], up[half:], down[half:]))
                stack.append((level, query[:half], node[:half], up[:half], down[:half]))
                continue
            width = self.starts[level][node + 1] - self.starts[level][node]
            small = width <= LEAF if level < len(self.keys) else np.ones(len(node), bool)
            if small.any():
                yield from self._words(query[small], self.starts[level][node[small]], width[small])
            if small.all():
                continue
            open_ = ~small
            query, node, up, down = query[open_], node[open_], up[open_], down[open_]
            keys, found = self.keys[level], []
            for step in (0, 1, -1):
                able = np.arange(len(query)) if not step else np.flatnonzero((up if step > 0 else down) > 0)
                key = node[able] * self.base + (vectors[query[able], level] + step)
                at = np.searchsorted(keys, key)
                hit = (vectors[query[able], level] + step >= 0) & (at < len(keys))
                hit[hit] = keys[at[hit]] == key[hit]
                kept = able[hit]
                found.append((query[kept], at[hit], up[kept] - (step > 0), down[kept] - (step < 0)))
            stack.append((level + 1, *(np.concatenate([f[k] for f in found]) for k in range(4))))

    def _words(self, query: np.ndarray, start: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        before = np.cumsum(width) - width
        first = 0
        while first < len(query):
            last = max(int(np.searchsorted(before, before[first] + 4 * FRONT)), first + 1)
            some = width[first:last]
            nth = np.arange(int(some.sum())) - np.repeat(before[first:last] - before[first], some)
            yield np.repeat(query[first:last], some), self.order[np.repeat(start[first:last], some) + nth]
            first = last


def near_by_one(runs: byte_words.Runs, a: np.ndarray, b: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether words a and b differ by one replaced letter, or b by one more letter; where `ordered`, only if a < b."""
    size, longer = (runs.ends - runs.starts)[a], (runs.ends - runs.starts)[b]
    out = np.zeros(len(a), bool)
    before = np.cumsum(size) - size
    first = 0
    while first < len(a):
        last = max(int(np.searchsorted(before, before[first] + (1 << 21))), first + 1)
        some, start = size[first:last], before[first:last] - before[first]
        place = np.arange(int(some.sum())) - np.repeat(start, some)
        here = np.repeat(runs.starts[a[first:last]], some) + place
        there = np.repeat(runs.starts[b[first:last]], some) + place
        left = runs.data[here]
        differs = left != runs.data[there]
        whole = np.repeat(some, some)
        at = np.minimum.reduceat(np.where(differs, place, whole), start)
        replaced = np.add.reduceat(differs, start, dtype=np.int64) == 1
        shifted = np.maximum.reduceat(np.where(left != runs.data[there + 1], place, -1), start)
        spot = np.minimum(at, some - 1)
        less = runs.data[runs.starts[a[first:last]] + spot] < runs.data[runs.starts[b[first:last]] + spot]
        inserted = (longer[first:last] == some + 1) & (shifted < at)
        out[first:last] = np.where(longer[first:last] == some, replaced & (less | ~ordered[first:last]), inserted)
        first = last
    return out


def _pairs(rows: pa.Table, levels: int) -> Iterator[pa.RecordBatch]:
    """(word, near, near_n), both ways, of the pairs within the whole cells of `rows`."""
    words = rows.column("word").combine_chunks()
    runs, vectors = _vectors(words)
    vectors = vectors[:, levels:]
    cell, block = rows.column("cell").combine_chunks(), rows.column("block").to_numpy()
    codes = cell.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(np.concatenate(([False], (codes[1:] != codes[:-1]) | (block[1:] != block[:-1]))))
    kind, n = rows.column("kind").to_numpy(), rows.column("n").to_numpy()
    size = runs.ends - runs.starts
    homes, asked = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if not len(homes) or not len(asked):
        return
    trie = Trie(group[homes], vectors[homes])
    up, down = rows.column("surplus").to_numpy()[asked], rows.column("deficit").to_numpy()[asked]
    for q, w in trie.search(group[asked], vectors[asked], up, down):
        a, b = asked[q], homes[w]
        own = (up[q] == 1) & (down[q] == 1) & (size[a] == size[b])  # a search in the word's own cell
        fits = np.flatnonzero(near_by_one(runs, a, b, own))
        if len(fits):
            a, b = a[fits], b[fits]
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(np.concatenate((a, b)))), words.take(pa.array(np.concatenate((b, a)))),
                 pa.array(np.concatenate((n[b], n[a])))], names=["word", "near", "near_n"])


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """(word, near, near_n) for all pairs of words one code point apart, both ways; near_n is the near word's count."""
    spark = vocabulary.sparkSession
    total = vocabulary.count()
    levels, largest = 1, CELL_WORDS + 1
    while largest > CELL_WORDS and levels < LEVELS:
        levels += 1
        sizes = placed(vocabulary, levels).where("kind = 0").groupBy("cell").agg(F.count("*").alias("size"))
        largest = sizes.agg(F.max("size")).head()[0] or 0
    rows = placed(vocabulary, levels)
    if largest > CELL_WORDS:
        blocks = sizes.where(F.col("size") > CELL_WORDS).select("cell", F.ceil(F.col("size") / CELL_WORDS).cast("int").alias("blocks"))
        rows = rows.join(blocks, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.explode(F.expr(
            "if(kind = 0, array(CAST(pmod(xxhash64(word), blocks) AS INT)), sequence(0, blocks - 1))"))).drop("blocks")
    else:
        rows = rows.withColumn("block", F.lit(0))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total * len(_moves(levels)) // (20 * CHUNK_ROWS) + 1)
    sorted_rows = rows.repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK_ROWS:
                table = pa.Table.from_batches(held)
                cell, block = table.column("cell").combine_chunks(), table.column("block").to_numpy()
                codes = cell.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                begins = np.flatnonzero((codes != codes[-1]) | (block != block[-1]))
                if len(begins):  # all but the last cell are whole
                    yield from _pairs(table.slice(0, begins[-1] + 1), levels)
                    held = table.slice(begins[-1] + 1).to_batches()
        if held:
            yield from _pairs(pa.Table.from_batches(held), levels)

    return common.materialise(sorted_rows.mapInArrow(run, "word string, near string, near_n bigint"), "near-words")


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n for the words of (word, n).

    A form has at least `times` its word's count, so chains of forms are short, and each round of following them
    halves what is left.
    """
    vocabulary = common.materialise(
        counts.where("word IS NOT NULL").groupBy("word").agg(F.sum(F.coalesce("n", F.lit(0))).cast("bigint").alias("n")), "words")
    near = near_pairs(vocabulary).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    best = vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), (-F.col("best.less")).alias("best_n"), F.col("best.near"))
    follows = F.col("best_n") >= times * F.col("n")
    forms = common.materialise(best.select(
        "word", "n", "n_near", F.when(follows, F.col("near")).alias("form"), F.when(follows, F.col("best_n")).alias("form_n")), "forms")
    steps = common.materialise(forms.where("form IS NOT NULL").selectExpr("word", "form AS root"), "roots")
    while True:
        further = steps.join(steps.selectExpr("word AS root", "root AS next"), "root", "left").selectExpr(
            "word", "coalesce(next, root) AS root", "next IS NOT NULL AS moved")
        moved = common.materialise(further, "roots")
        steps = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return forms.join(steps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent words of all documents with their near words, forms and roots."""
    return variants(word_counts(common.table(spark, sf_dir, "documents")))


ORACLE = f"""
WITH t AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
         translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
o AS (SELECT id, run, id || ':' || run AS named, count(*) AS c FROM t WHERE length(run) >= {LEAST_LETTERS} GROUP BY id, run),
h AS (SELECT run, c, {crc.crc32_sql('named')} AS h FROM o),
s AS (SELECT CASE WHEN h % {SLIP} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
             ELSE run END AS word, c FROM h),
v AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM s WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
less AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(near_n) AS best_n, arg_min(near, {{'l': -near_n, 'w': encode(near)}}) AS near FROM pairs GROUP BY word),
f AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {TIMES} * n THEN near END AS form,
             CASE WHEN best_n >= {TIMES} * n THEN best_n END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (
  WITH RECURSIVE c AS (SELECT word, form AS root, 1 AS k FROM f WHERE form IS NOT NULL
                       UNION ALL SELECT c.word, f.form, k + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL)
  SELECT word, max_by(root, k) AS root FROM c GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM f LEFT JOIN chain USING (word)
"""
