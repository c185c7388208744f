"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A unit of text is encoded from left to right. At each place the longest piece found by an
Aho-Corasick automaton is tried first, then shorter ones; a piece may follow another when merging
their joined characters anew gives back just these two. When none may follow, the place is marked in
a bit field of failed places and the last piece is taken back. Pieces that merging would not produce
from their own characters are never tried.

No piece holds a space mark after another character, so a text is cut before each run of space
marks and its units are encoded apart; a worker remembers the units it has met.

Defined results: a null or empty text gives the begin and end ids only and decodes to ''. Characters
without a piece become byte pieces. Rows are independent, so ties, repeated rows and empty tables
need no rule; own columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common, ragged

SPACE = "▁"
#: Units a worker remembers in each of two generations, and the bytes of units and codes therein.
REMEMBERED, REMEMBERED_BYTES = 100_000, 8 << 20
#: Pairs of pieces whose verdict a worker remembers before it begins anew.
REMEMBERED_PAIRS = 1 << 18
#: Bytes of text handled at a time.
SLICE_BYTES = 2 << 20
_ODD_SPACING = f"^$|  |^ | $|{SPACE}"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model, with encoder and decoder."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(size)]
        self.rank = {names[i]: model.get_score(i) for i in range(size) if not special[i]}
        self.ids = {names[i]: i for i in range(size) if not special[i]}
        self.characters = {name for name in self.ids if len(name) == 1}
        self.bytes = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.names = names
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if self.merged(name) == [name]:
                self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.length = [len(name) for name in names]
        #: The longest usable piece that a piece begins with, itself excluded; -1 if none.
        self.shorter = [-1] * size
        for name, i in self.ids.items():
            for end in range(len(name) - 1, 0, -1):
                if name[:end] in self.automaton:
                    self.shorter[i] = self.ids[name[:end]]
                    break
        self.compatible: dict[int, bool] = {}
        surface = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                surface.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i):
                surface.append(b"")
            elif model.is_unknown(i):
                surface.append(" ⁇ ".encode())
            else:
                surface.append(name.replace(SPACE, " ").encode())
        self.surface_starts = np.concatenate(([0], np.cumsum([len(s) for s in surface])))
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.leads = np.array([not special[i] and names[i].startswith(SPACE) for i in range(size)])
        self.is_control = np.array([model.is_control(i) for i in range(size)])
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self.memo = ragged.Memo(self.encode_units, "<u2" if size <= 1 << 16 else "<u4", REMEMBERED, REMEMBERED_BYTES)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves: the best-ranked neighbours first, the leftmost of equals."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, first: int, second: int) -> bool:
        key = first << 32 | second
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= REMEMBERED_PAIRS:
                self.compatible.clear()
            a, b = self.names[first], self.names[second]
            known = self.compatible[key] = self.merged(a + b) == [a, b]
        return known

    def encode_span(self, text: str) -> list[int]:
        """Backtracking over characters that all have a piece."""
        size, length, shorter, compatible = len(text), self.length, self.shorter, self.compatible
        longest = [0] * (size + 1)
        for end, piece in self.automaton.iter(text):
            longest[end - length[piece] + 1] = piece  # longer ones end later
        failed, place, last = 0, 0, -1
        piece = longest[0]
        out: list[int] = []
        while place < size:
            while piece >= 0:
                end = place + length[piece]
                if not failed >> end & 1:
                    if last < 0:
                        break
                    fits = compatible.get(last << 32 | piece)
                    if fits is None:
                        fits = self.may_follow(last, piece)
                    if fits:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                last, place = piece, end
                piece = longest[end]
            else:
                failed |= 1 << place
                if last < 0:
                    raise ValueError(f"no valid encoding of {text!r}")
                piece = shorter[out.pop()]
                place -= length[last]
                last = out[-1] if out else -1
        return out

    def encode_unit(self, text: str) -> list[int]:
        """Characters without a piece stand for themselves as byte pieces and part the text."""
        known = self.ids
        if self.characters.issuperset(text):
            return self.encode_span(text)
        out, start = [], 0
        for k, c in enumerate(text):
            if c not in known:
                if k > start:
                    out += self.encode_span(text[start:k])
                out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unk]
                start = k + 1
        return out + self.encode_span(text[start:])

    def encode_units(self, units: list[str]) -> list[bytes]:
        kind, encode = "H" if len(self.names) <= 1 << 16 else "I", self.encode_unit
        return [array(kind, encode(u)).tobytes() for u in units]

    def _runs(self, flat: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, distinct = ragged.coded(flat)
        starts, values = self.memo.runs(distinct.to_pylist())
        ids, begins = ragged.gather(codes, starts, values)
        return ids, begins[bounds]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, without begin and end, and where each text begins."""
        texts = ragged.filled(texts)
        odd = pc.match_substring_regex(texts, _ODD_SPACING).to_numpy(zero_copy_only=False)
        plain = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        offsets = plain.offsets.to_numpy()
        flat = plain.values.slice(offsets[0], offsets[-1] - offsets[0])
        mark, nothing = pa.scalar(SPACE, pa.large_string()), pa.scalar("", pa.large_string())
        ids, bounds = self._runs(pc.binary_join_element_wise(mark, flat, nothing), offsets - offsets[0])
        if odd.any():
            units = [_UNITS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
            more = np.concatenate(([0], np.cumsum([len(u) for u in units])))
            own, begins = self._runs(pa.array([u for row in units for u in row], pa.large_string()), more)
            order = np.empty(len(odd), np.int64)
            order[~odd], order[odd] = np.arange((~odd).sum()), (~odd).sum() + np.arange(odd.sum())
            ids, bounds = ragged.gather(order, np.concatenate((bounds, bounds[-1] + begins[1:])), np.concatenate((ids, own)))
        return ids, bounds

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids; one leading space is the encoder's own and is left out."""
        flat, begins = ragged.gather(ids, self.surface_starts, self.surface)
        whole = flat.tobytes()
        seen = np.flatnonzero(~self.is_control[ids]) if len(ids) else np.zeros(0, np.int64)
        firsts = np.searchsorted(seen, bounds[:-1])
        out = []
        for row, (i, j) in enumerate(zip(bounds[:-1], bounds[1:])):
            first = seen[firsts[row]] if firsts[row] < len(seen) else j
            skip = 1 if first < j and self.leads[ids[first]] else 0
            raw = whole[begins[i] + skip:begins[j]]
            try:
                out.append(raw.decode())
            except UnicodeDecodeError:
                out.append(self._repaired(ids[i:j], skip))
        return out

    def _repaired(self, ids: np.ndarray, skip: int) -> str:
        """Text of ids whose byte pieces are no valid UTF-8: each stray byte gives U+FFFD."""
        parts, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in range(1, 5):
                    try:
                        parts.append(bytes(run[at:at + n]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    parts.append("�")
                at += n
            run.clear()

        for i in ids:
            raw = self.surface[self.surface_starts[i]:self.surface_starts[i + 1]].tobytes()
            if self.is_byte[i]:
                run += raw
            elif not self.is_control[i]:
                flush()
                parts.append(raw.decode())
        flush()
        return "".join(parts)[skip:]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One vocabulary a worker process."""
    return Pieces(path)


def _framed(vocabulary: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts with begin and end ids, and where each text begins."""
    ids, bounds = vocabulary.encode(texts)
    n = len(bounds) - 1
    framed = np.empty(len(ids) + 2 * n, "<u4")
    starts = bounds + 2 * np.arange(n + 1)
    inside = np.ones(len(framed), bool)
    inside[starts[:-1]] = inside[starts[1:] - 1] = False
    framed[inside] = ids
    framed[starts[:-1]], framed[starts[1:] - 1] = vocabulary.bos, vocabulary.eos
    return framed, starts


def encoded(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str | None = None,
            decode: bool = False) -> DataFrame:
    """(key, ids) for each row: begin id, pieces, end id, as little-endian unsigned 32-bit integers.

    With `decode` also `decoded`, the text of these ids, made by the same worker, so that a task keeps
    one vocabulary in memory instead of two.
    """
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            for part in ragged.slices(batch, "text", SLICE_BYTES):
                framed, starts = _framed(vocabulary, part.column("text"))
                column = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), part.num_rows, [None, pa.py_buffer((starts * 4).astype(np.int64)), pa.py_buffer(framed)])
                out = {"key": part.column("key"), "ids": column.cast(pa.binary())}
                if decode:
                    out["decoded"] = pa.array(vocabulary.decode(framed.astype(np.int64), starts), pa.string())
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, ids binary" + ", decoded string" * decode)


def decoded(coded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded`, the text of the `ids` of `encoded`, where these were stored."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for batch in batches:
            for part in ragged.slices(batch, "ids", SLICE_BYTES):
                rows = part.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
                bounds = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int64)
                texts = pa.array(vocabulary.decode(ids, bounds), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "decoded"])

    return coded.mapInArrow(run, f"key {coded.schema['key'].dataType.simpleString()}, ids binary, decoded string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: the number of ids, and the SHA-256 of the ids and of the text decoded from them."""
    return encoded(docs, text, key, path, decode=True).select(
        F.col("key").alias(key), (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded."""
    return digests(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
