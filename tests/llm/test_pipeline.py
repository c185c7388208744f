"""Every stage of the pipeline on the smallest tables, against brute force or an independent statement."""

import hashlib
import os
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from crawlscore.llm import common, pieces, queries
from test_near_dedup import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")


def stated(name, docs):
    """Rows of a query's DuckDB statement over `docs`."""
    connection = duckdb.connect()
    connection.register("documents", docs.toArrow())
    cursor = connection.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    return [dict(zip(names, row)) for row in cursor.fetchall()]


def rows_of(docs):
    return Counter(map(tuple, docs.collect()))


def encoded(docs, library):
    found = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        found[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += 1
    return found


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage, and the output of the last."""
    out = [common.table(spark, DATA, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(common.materialise(stage(spark, out[-1], DATA), "tested"))
    return out


def test_filters_keep_whole_rows(spark, stages):
    docs, good, clean = stages[:3]
    kept = {r.doc_id for r in queries.QUERIES["op6_quality_classifier"](spark, DATA).collect() if r.kept}
    assert rows_of(good) == Counter({r: n for r, n in rows_of(docs).items() if r[docs.columns.index("doc_id")] in kept})
    kept = {r["doc_id"] for r in stated("op1_quality_rules", good) if r["kept"]}
    assert rows_of(clean) == Counter({r: n for r, n in rows_of(good).items() if r[good.columns.index("doc_id")] in kept})
    assert 0 < clean.count() < good.count() < docs.count()


def test_one_document_of_each_group_stays(stages):
    clean, single = stages[2:4]
    groups = {i: root for i, _, root in brute([(r.doc_id, r.text) for r in clean.select("doc_id", "text").collect()])}
    left = [r.doc_id for r in single.select("doc_id").collect()]
    assert len(left) == len(set(left)) and sorted(groups[i] for i in left) == sorted(set(groups.values()))
    assert not rows_of(single) - rows_of(clean)


def test_mix_repeats_whole_rows(stages):
    single, mixed = stages[3:5]
    copies = {r["doc_id"]: r["taken"] // r["size"] for r in stated("op9_mixing", single) if r["size"]}
    at = single.columns.index("doc_id")
    want = Counter({r: n * copies[r[at]] for r, n in rows_of(single).items() if r[at] in copies})
    got = Counter({r: n for r, n in rows_of(mixed).items() if r[at] in copies})
    assert got == +want and max(got.values()) > 1


def words(seed, n):
    return " ".join(f"{w} {seed}x{k}," for k, w in zip(range(n), ["the", "of", "river", "and", "north"] * n))


LONG = words("long", 60_000)
ODD = [  # doc_id, text, lang, source
    (1, words("a", 60), "en", "s1"), (2, words("a", 60), "en", "s1"), (5, words("b", 60), None, None), (5, words("b", 60), None, None),
    (7, words("c", 60), "en", "s2"), (7, words("d", 60), "en", "s2"), (None, words("e", 60), "en", "s2"), (None, None, None, None),
    (8, "", "en", "s1"), (9, None, "en", None), (10, "too short", None, "s1"), (11, LONG, "en", "s3"), (3, LONG + " end", "en", "s3")]


def folder_of(path, rows, labels):
    clash = [("row", pa.int64()), ("key", pa.string()), ("kept", pa.bool_()), ("size", pa.string()), ("copies", pa.int32())]
    columns = {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(
        [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())])}
    columns |= {"n_chars": pa.array([len(r[1] or "") for r in rows], pa.int64())}
    columns |= {n: pa.nulls(len(rows), t) for n, t in clash}
    pq.write_table(pa.table(columns), path / "documents.parquet")
    label = {n: pa.array([r[k] for r in labels], pa.int64()) for k, n in enumerate(("doc_id", "quality"))}
    pq.write_table(pa.table(label), path / "labels.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    folder = folder_of(tmp_path, ODD, [])
    docs = common.table(spark, folder, "documents")
    good = corpus_pipeline.classify(spark, docs, folder)
    assert rows_of(good) == rows_of(docs)  # no labels, no verdict
    clean = corpus_pipeline.apply_rules(spark, good, folder)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in clean.collect()) == sorted(r[0] or 0 for r in ODD if len((r[1] or "").split()) >= 50)
    single = common.materialise(corpus_pipeline.deduplicate(spark, clean, folder), "tested")
    assert single.columns == docs.columns and not rows_of(single) - rows_of(docs)
    assert sorted(r.doc_id or 0 for r in single.collect()) == [0, 1, 3, 5, 7]
    assert rows_of(single) == rows_of(corpus_pipeline.deduplicate(spark, clean.repartition(5), folder))
    mixed = corpus_pipeline.mix(spark, single, folder)
    assert mixed.columns == docs.columns and set(rows_of(mixed)) <= set(rows_of(single))
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == encoded(mixed, library)


def test_empty_tables(spark, tmp_path):
    folder = folder_of(tmp_path, [], [(1, 1), (2, None)])
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert rows_of(stage(spark, docs, folder)) == Counter() and stage(spark, docs, folder).columns == docs.columns
    result = corpus_pipeline.run(spark, folder)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and result.count() == 0


def test_encoding_and_run(spark, stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    want = encoded(stages[4], library)
    for result in (stages[5], corpus_pipeline.run(spark, DATA)):
        assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in result.collect()) == want
