"""Token ids in binary files: frequency-ranked ids, byte-aligned codes, control bytes apart.

Documents are dealt out and sorted by id; each task encodes its range and writes one file of blocks.
A block ranks the ids by how often it holds them, so that frequent ones take one byte. Its layout,
all numbers little-endian:

    u32 documents, u32 ids, u32 ranks, u32 data bytes
    i64 id of each document, u8 whether it is not null (one for each document), u32 ids of each document
    u32 id of each rank
    control bytes: two bits for each id, its code's length less one, the first id in the lowest bits
    data bytes: the ranks' codes, of one to four bytes

A reader finds the lengths of four codes in a table by their control byte, and places by summing up.
A block has whole documents and about BLOCK_IDS ids.

Defined results: a null or empty text has the end id only. Documents are in ascending order of id,
null first; rows with the same id are ordered by a hash of their text. Strings that look like
special tokens are ordinary text. An empty table gives no file and no rows. Other columns are not stored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlscore.llm import common, encoded, ragged, storage

BLOCK_IDS = 1 << 21
END_ID = 0
#: Words between spaces, and pieces of these, that a worker remembers, twice.
REMEMBERED = 600_000
#: Bytes of text encoded at a time.
SLICE_BYTES = 6 << 20
#: Words encoded in one call.
ROW_WORDS = 2_000
_LETTER = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F"
#: Places where the vocabulary's pattern always ends a piece: a letter before ASCII punctuation or a line feed, and a
#: single line feed before a letter.
_CUTS = re.compile(rf"(?<=[{_LETTER}])(?=[!-/:-@\[-`{{-~\n])|(?<=\S\n)(?=[{_LETTER}])")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~\n]")
_WHITE = re.compile(r"\s")
#: A space after white space: such texts are encoded whole, all others word by word.
_ODD_SPACING = r"[\s\v\x1c-\x1f\x{85}\p{Z}] "


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """A byte-level tokenizer that encodes each distinct word of a batch once.

    Its pattern ends a piece before every space that follows another character than white space, so
    texts may be cut there; the ids are those of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo, self.parts = encoded.Store(REMEMBERED), encoded.Store(REMEMBERED)
        #: Bytes of each token: its characters stand for one byte each.
        names = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(names.values()) + 1, np.int64)
        for name, i in names.items():
            self.widths[i] = len(name)
        self.white = {chr(c) for c in range(0x3001) if chr(c).isspace()} | {""}

    def _unseen(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of unseen units, which are cut where the pattern always ends a piece, so that a word and the
        same word before a comma are encoded once."""
        cut = [_CUTS.split(u) if _PUNCTUATION.search(u) else (u,) for u in units]
        place: dict[str, int] = {}
        codes = np.fromiter((place.setdefault(p, len(place)) for parts in cut for p in parts), np.int64)
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        distinct = list(place)
        starts, values = self.parts.runs(pa.array(distinct, pa.large_string()), lambda at: self._coded([distinct[k] for k in at.tolist()]))
        ids, begins = ragged.gather(codes, starts, values)
        return np.diff(begins[np.concatenate(([0], np.cumsum(counts)))]), ids

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of texts. Those between which the pattern always ends a piece are encoded in rows of many: those
        that begin with a space one after another, those without white space with a line feed after each."""
        joined, lines, alone = [], [], []
        for k, t in enumerate(texts):
            if t[:1] == " " and t[-1:] not in self.white:
                joined.append(k)
            else:
                (alone if not t or _WHITE.search(t) else lines).append(k)
        runs = [*self._in_rows(texts, joined, ""), *self._in_rows(texts, lines, "\n")]
        found = self._ids([texts[k] for k in alone])
        runs.append((np.array(alone, np.int64), np.array([len(f) for f in found], np.int64),
                     np.fromiter((i for f in found for i in f), "<u4")))
        at = np.concatenate([r[0] for r in runs])
        sizes, ids = np.concatenate([r[1] for r in runs]), np.concatenate([r[2] for r in runs])
        order = np.argsort(at)
        ids, begins = ragged.gather(order, np.concatenate(([0], np.cumsum(sizes))), ids)
        return np.diff(begins), ids

    def _in_rows(self, texts: list[str], chosen: list[int], end: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for start in range(0, len(chosen), ROW_WORDS):
            some = chosen[start:start + ROW_WORDS]
            row = [texts[k] + end for k in some]
            ids = np.array(self._ids(["".join(row)])[0], "<u4")
            octets = np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in row])
            sizes = np.diff(np.searchsorted(np.cumsum(self.widths[ids]), octets) + 1, prepend=0)
            if end:  # a line feed is one id
                last = np.cumsum(sizes) - 1
                ids, sizes = np.delete(ids, last), sizes - 1
            yield np.array(some, np.int64), sizes, ids

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = ragged.filled(texts)
        odd = pc.match_substring_regex(texts, _ODD_SPACING).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offsets = plain.offsets.to_numpy()
        offsets, flat = offsets - offsets[0], plain.values.slice(offsets[0], offsets[-1] - offsets[0])
        codes, distinct = ragged.coded(flat)
        firsts, own = np.unique(codes[offsets[:-1]], return_inverse=True)  # a text's first word has no space in front
        codes = codes.astype(np.int64)
        codes[offsets[:-1]] = len(distinct) + own
        units = pa.concat_arrays([
            pc.binary_join_element_wise(pa.scalar("", pa.large_string()), distinct, pa.scalar(" ", pa.large_string())),
            distinct.take(pa.array(firsts))])
        starts, values = self.memo.runs(units, lambda at: self._unseen(units.take(pa.array(at)).to_pylist()))
        ids, begins = ragged.gather(codes, starts, values)
        bounds = begins[offsets]
        if odd.any():
            sizes, own = self._coded(texts.filter(pa.array(odd)).to_pylist())
            more = np.cumsum(sizes)
            order = np.empty(len(odd), np.int64)
            order[~odd], order[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
            ids, bounds = ragged.gather(order, np.concatenate((bounds, bounds[-1] + more)), np.concatenate((ids, own)))
        return ids, bounds


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    wide = ranks.astype("<u4")
    lengths = 1 + (wide > 0xFF).astype(np.uint8) + (wide > 0xFFFF) + (wide > 0xFFFFFF)
    data = wide.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    quads = np.zeros((len(wide) + 3) // 4 * 4, np.uint8)
    quads[:len(wide)] = lengths - 1
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


#: Lengths of the four codes that a control byte describes.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.int64) + 1
_MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def numbers(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The inverse of `coded`, by table lookup."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    places = np.cumsum(lengths) - lengths
    padded = np.frombuffer(data + bytes(3), np.uint8).astype(np.uint32)
    value = padded[places]
    for k in (1, 2, 3):
        value |= padded[places + k] << np.uint32(8 * k)
    return value & _MASKS[lengths]


def block(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One block; `ids` are those of all its documents, `sizes` how many each has."""
    counts = np.bincount(ids)
    distinct = np.flatnonzero(counts)
    distinct = distinct[np.argsort(-counts[distinct], kind="stable")]
    rank = np.zeros(len(counts), np.uint32)
    rank[distinct] = np.arange(len(distinct), dtype=np.uint32)
    control, data = coded(rank[ids])
    head = np.array([len(keys), len(ids), len(distinct), len(data)], "<u4").tobytes()
    known = np.array([k is not None for k in keys], np.uint8)
    return b"".join((head, np.array([k or 0 for k in keys], "<i8").tobytes(), known.tobytes(), sizes.astype("<u4").tobytes(),
                     distinct.astype("<u4").tobytes(), control, data))


def unblock(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Ids of documents, their sizes, and all token ids of a block."""
    n, count, ranks, size = (int(x) for x in np.frombuffer(raw, "<u4", 4))
    at = 16
    keys = np.frombuffer(raw, "<i8", n, at).tolist()
    known = np.frombuffer(raw, np.uint8, n, at + 8 * n)
    sizes = np.frombuffer(raw, "<u4", n, at + 9 * n).astype(np.int64)
    at += 13 * n
    of_rank = np.frombuffer(raw, "<u4", ranks, at)
    at += 4 * ranks
    quads = (count + 3) // 4
    found = numbers(raw[at:at + quads], raw[at + quads:at + quads + size], count)
    return [k if ok else None for k, ok in zip(keys, known)], sizes, of_rank[found]


_MANIFEST = "shard int, nth int, file string, start bigint, size bigint, n_docs bigint, n_ids bigint"


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Writes the files and returns their manifest, one row for each block, as a written table.

    Texts are shuffled once, before they are encoded. Range partitions are by (id, hash of the text),
    so that even one id on many rows is dealt out.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        system, base = storage.opened(folder)
        shard, name = storage.attempt_name("tokens", ".ids")
        rows: list[tuple] = []
        keys: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held, place, target = 0, 0, None

        def flush() -> None:
            nonlocal held, place, target
            if not keys:
                return
            if target is None:
                system.create_dir(base, recursive=True)
                target = system.open_output_stream(f"{base}/{name}")
            raw = block(keys, np.concatenate(sizes), np.concatenate(parts))
            target.write(raw)
            rows.append((shard, len(rows), name, place, len(raw), len(keys), held))
            place += len(raw)
            keys.clear(), parts.clear(), sizes.clear()
            held = 0

        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                ids, bounds = words.encode(part.column("text"))
                n = len(bounds) - 1
                ends = bounds[1:] + np.arange(n)
                framed = np.empty(len(ids) + n, np.uint32)
                inside = np.ones(len(framed), bool)
                inside[ends] = False
                framed[inside], framed[ends] = ids, END_ID
                keys.extend(part.column("key").to_pylist())
                parts.append(framed)
                sizes.append(bounds[1:] - bounds[:-1] + 1)
                held += len(framed)
                if held >= BLOCK_IDS:
                    flush()
        flush()
        if target is not None:
            target.close()
        columns = zip(*rows) if rows else [[]] * 7
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)],
                                         names=["shard", "nth", "file", "start", "size", "n_docs", "n_ids"])

    own = docs.select(F.col(f"`{key}`").cast("bigint").alias("key"), F.col(f"`{text}`").alias("text"))
    tie = F.xxhash64("text")
    dealt = own.repartitionByRange(F.col("key").asc_nulls_first(), tie).sortWithinPartitions(
        F.col("key").asc_nulls_first(), tie)
    return common.materialise(dealt.mapInArrow(run, _MANIFEST), "token-manifest")


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """(key, start, ids) of each document, read block by block; `ids` is binary, `start` counts all ids before it.

    Sums run over blocks within a file and over files, never over documents.
    """
    before = F.coalesce(F.sum("n_ids").over(
        Window.partitionBy("shard").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.groupBy("shard").agg(F.sum("n_ids").alias("all_ids")).withColumn(
        "ahead", F.coalesce(F.sum("all_ids").over(
            Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = manifest.withColumn("before", before).join(files.select("shard", "ahead"), "shard").select(
        "file", "start", "size", (F.col("ahead") + F.col("before")).cast("bigint").alias("first"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = storage.opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                keys, sizes, ids = unblock(storage.read_range(system, f"{base}/{row['file']}", row["start"], row["size"]))
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                raw = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(keys), [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(bounds[:-1] + row["first"]), raw.cast(pa.binary())],
                    names=["key", "start", "ids"])

    return blocks.repartition(parts, "file", "start").mapInArrow(run, "key bigint, start bigint, ids binary")


def digests(found: DataFrame, key: str) -> DataFrame:
    return found.select(F.col("key").alias(key), "start", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = common.new_folder(spark, "token-files")
    return digests(read(spark, folder, write(docs, folder)), "doc_id")
