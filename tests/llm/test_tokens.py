"""Piece encoding against its library, token files as exact round trips."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from crawlscore.llm import common, encoded, pieces, ragged, token_files

ALPHABET = "aabbee thTH  \n\t.,1203#<>0xA▁é漢字ñß😀\x00\x1f　\x0b\x85"


def texts(seed, n=3000):
    rng = random.Random(seed)
    fixed = [None, "", " ", "  ", "a", " a", "a ", "<0x0A>", "<s>", "▁", "a" * 50, " " * 40, "\n", "the <|endoftext|> end"]
    return fixed + ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_pieces_equal_library():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    vocabulary = pieces.pieces(pieces.model_path())
    rows = texts(1)
    ids, bounds = vocabulary.encode(pa.array(rows))
    for k, text in enumerate(rows):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == library.encode(text or "")
    rng = random.Random(2)
    runs = [[rng.randrange(400 if rng.random() < 0.6 else 32_000) for _ in range(rng.randint(0, 9))] for _ in range(3000)]
    flat = np.array([i for run in runs for i in run], np.int64)
    ends = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int64)
    assert vocabulary.decode(flat, ends) == [library.decode(r) for r in runs]


def test_pieces_query_columns(spark):
    import hashlib

    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rows = [*texts(3, 40), "word " * 50_000, "x" * 20_000]
    docs = spark.createDataFrame([(k, t, "i") for k, t in enumerate(rows)] * 2, "doc_id bigint, text string, ids string")
    got = pieces.digests(docs).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        ids = library.encode(rows[r.doc_id] or "", add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert pieces.digests(docs.limit(0)).count() == 0
    stored = pieces.decoded(pieces.encoded(docs)).select("key", "ids", "decoded")
    assert sorted(map(str, stored.collect())) == sorted(map(str, pieces.encoded(docs, decode=True).collect()))


def test_words_equal_whole_texts():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.vocabulary_path())
    library.encode_special_tokens = True
    rows = texts(4) + ["plain words, with  two spaces", "plain words only.\nNext line", "tail \n", "x\u3000 y"]
    ids, bounds = token_files.vocabulary(token_files.vocabulary_path()).encode(pa.array(rows))
    for k, text in enumerate(rows):
        assert ids[bounds[k]:bounds[k + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("values", [[], [0], [255, 256, 65535, 65536, 2**24, 2**32 - 1], list(range(1000))])
def test_codes_round_trip(values):
    numbers = np.array(values, np.uint32)
    control, data = token_files.coded(numbers)
    assert len(control) == (len(values) + 3) // 4
    assert token_files.numbers(control, data, len(values)).tolist() == values


def test_block_round_trip():
    ids = np.array([5, 0, 7, 7, 7, 0, 0], np.uint32)
    keys, sizes, back = token_files.unblock(token_files.block([None, -3, 9], np.array([2, 4, 1]), ids))
    assert keys == [None, -3, 9] and sizes.tolist() == [2, 4, 1] and back.tolist() == ids.tolist()


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_files.vocabulary_path())
    library.encode_special_tokens = True
    rows = [(k, t, 0) for k, t in enumerate(texts(6, 60))] + [(5, "a", 0), (None, "zz", 0), (99_999, "long one " * 30_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, start bigint").repartition(7)
    folder = common.new_folder(spark, "token-files")
    got = token_files.digests(token_files.read(spark, folder, token_files.write(docs, folder)), "doc_id").collect()
    want = sorted(((k, t) for k, t, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [k for k, _ in want]
    place = 0
    for r in ordered:
        ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for k, t in want if k == r.doc_id]
        assert r.start == place
        assert (r.n_tokens, r.ids_crc32) in {(len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for i in ids}
        place += r.n_tokens
    empty = common.new_folder(spark, "token-files")
    assert token_files.read(spark, empty, token_files.write(docs.limit(0), empty)).count() == 0


def test_slices_cover_the_batch():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "", "b" * 100, "c"] * 3)], names=["text"])
    parts = list(ragged.slices(batch, "text", 12))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert len(parts) > 3


def test_units_cut_at_punctuation_equal_the_library():
    """Words before punctuation, contractions, line feeds of any number, digits and other scripts, in generated texts."""
    rng = random.Random(7)
    bits = ["word", "Word", "élan", "ß", "don't", "I'll", "x's", "''s", ",", ".", "...", "\n", "\n\n", " \n", "\t", "12", "a1", "ªº", "²", "日本", "é́", "_", "`", "~", "\r\n", "\x0b", " ", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", "", " ", " "]) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    words = token_files.Vocabulary(token_files.vocabulary_path())
    for limit in (7, 100_000):
        words.memo, words.parts = encoded.Store(limit), encoded.Store(limit)
        for _ in range(2):
            ids, bounds = words.encode(pa.array(texts))
            want = words._ids(texts)
            assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == want
