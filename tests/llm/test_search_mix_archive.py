"""Threshold search, mixing and web archives against brute force."""

import base64
import hashlib
import io
import random
import struct
import zipfile

import numpy as np
import pytest
from pyarrow import fs

from crawlscore.llm import common, mixing, threshold_search as ts, warc_zip as wz


def brute(rows, queries, k):
    whole = {i: [int(np.floor(256 * float(x))) for x in v] for i, v in rows}
    out = set()
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], whole[i])), i) for i in whole if i != q)
        out |= {(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("step", [0.05, 1.0])
def test_search_equals_brute_force(spark, step):
    rng = random.Random(7)
    rows = [(i, [round(rng.gauss(0, 1) / step) * step for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, list(rows[3][1])) for i in range(30)] + [(2000, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(6)
    queries = [i for i, _ in rows if i % 50 == 0]
    got = ts.search(table, table.where("vec_id % 50 = 0"), 5)
    exact = [(r.vec_id, r.embedding) for r in table.collect()]
    assert {tuple(r) for r in got.collect()} == brute(exact, queries, 5)


def test_search_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (None, [1.0, 1.0]), (5, [])]
    table = spark.createDataFrame(rows + rows[:1], "vec_id bigint, embedding array<float>")
    got = {tuple(r) for r in ts.search(table, table.where("vec_id % 50 = 0"), 5).collect()}
    assert got == {(0, 1, 50, 65536), (0, 2, 5, 0), (50, 1, 0, 65536), (50, 2, 5, 0)}
    assert ts.search(table.limit(0), table.limit(0), 5).count() == 0
    far = spark.createDataFrame([(0, [3e30]), (1, [3e30]), (2, [-3e30])], "vec_id bigint, embedding array<float>")
    assert {tuple(r) for r in ts.search(far, far.where("vec_id = 0"), 5).collect()} == {
        (0, 1, 1, (1 << 63) - 1), (0, 2, 2, -(1 << 63))}


def test_threshold_stops_early():
    vectors = np.zeros((4000, 2))
    vectors[:, 0] = np.arange(4000)
    order = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
    seen = []
    real, ts.scores = ts.scores, lambda v, q: seen.append(len(v)) or (v @ q).astype(np.int64)
    try:
        ids, found = ts.best(np.arange(4000), vectors, order, 3999, np.array([2.0, 0.0]), 3)
    finally:
        ts.scores = real
    assert ids == [3998, 3997, 3996] and found == [7996, 7994, 7992]
    assert sum(seen) < 100


def water(sizes, weights, share=1.5, most=2.0):
    full, wanted = set(), share * sum(sizes)
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        level = (wanted - sum(most * sizes[i] for i in full)) / sum(weights[i] for i in rest) if rest else 0
        more = {i for i in rest if level * weights[i] > most * sizes[i]}
        if not more:
            return [most * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
        full |= more


def test_targets_follow_weights_and_limits(spark):
    sizes = [10, 400, 0, 1000, 50, 7, 90, 3000]
    rows = [(f"s{i}" if i < 7 else None, s) for i, s in enumerate(sizes)]
    totals = spark.createDataFrame(rows, "source string, source_size bigint").repartition(3)
    got = {r.source: r.target for r in mixing.targets(totals).collect()}
    want = water(sizes, [(3, 1, 2)[i % 3] for i in range(8)])
    assert [got[s] for s, _ in rows] == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes))


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.randint(0, 60), f"s{i % 4}", 5, "x") for i in range(6000)]
    rows += [(9000, None, None, 5, "x"), (9001, "", "s1", 5, "x"), (9002, "tail " * 100_000, None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, rate string")
    found = mixing.mixed(docs)
    got = found.collect()
    assert len(got) == len(rows)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.copies <= 2
        taken[r.row.source] = taken.get(r.row.source, 0) + r.copies * r.size
        target[r.row.source] = r.target
    for source in ("s0", "s1", "s2", "s3"):
        assert taken[source] == pytest.approx(target[source], rel=0.06)
    assert sorted(map(str, found.collect())) == sorted(map(str, got))
    mix = mixing.emitted(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r.copies for r in got)
    assert mixing.emitted(docs.limit(0)).count() == 0
    assert mixing.mixed(docs.where("text = ''")).head().copies == 0


PAGES = [(3, "http://a/é b", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (2, None, None), (7, "u", ""), (9, "v", "only"),
         (None, "w", "<p>x</p>"), (None, "w", "nobody"), (None, "w", "nobody"), (1, "http://a", "<p>x</p>"), (12, "z", "漢" * 200_000)]


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_archive_round_trip(spark, least):
    pages = spark.createDataFrame([(*p, "f") for p in PAGES], "page_id bigint, url string, html string, file string").repartition(3)
    folder = common.new_folder(spark, "packages")
    got = wz.read(spark, folder, wz.write(pages, folder, least=least)).collect()
    want = []
    for i, _, html in PAGES:
        same = [j for j, _, h in PAGES if (h or "") == (html or "") and j is not None]
        size = len((html or "").encode())
        first = min(same) if same and size >= least and (i is None or i != min(same)) else None
        want.append((i, size, sha(html), "response" if first is None else "revisit", first))
    key = lambda r: tuple((x is not None, x or 0) for x in r if not isinstance(x, str)) + tuple(x for x in r if isinstance(x, str))
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    assert {r.payload.decode() for r in got if r.record_type == "response"} == {h or "" for _, _, h in PAGES}
    small = common.new_folder(spark, "packages")
    manifest = wz.write(pages, small, least=least, package_bytes=1)  # a package for each record
    assert [r.n_records for r in manifest.collect()] == [1] * len(PAGES)
    assert sorted((tuple(r)[:5] for r in wz.read(spark, small, manifest).collect()), key=key) == sorted(want, key=key)
    empty = common.new_folder(spark, "packages")
    assert wz.read(spark, empty, wz.write(pages.limit(0), empty)).count() == 0


def test_spans_read_their_part_of_the_index(spark):
    n = 2 * wz.READ_RECORDS + 7
    pages = spark.range(n).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html").coalesce(1)
    folder = common.new_folder(spark, "packages")
    manifest = wz.write(pages, folder)
    got = wz.read(spark, folder, manifest).selectExpr("page", "cast(payload AS string) AS html").collect()
    assert sorted((r.page, r.html) for r in got) == [(i, f"page {i}") for i in range(n)]
    system, base = wz.storage.opened(folder)
    path = f"{base}/{manifest.head().file}"
    members = wz.directory(system, path)
    places = wz.index(system, path, members)
    assert len(places) == n and wz.index(system, path, members, 5, 9) == places[5:9]
    assert wz.index(system, path, members, n - 1, n + 9) == places[-1:] and wz.index(system, path, members, n, n + 1) == []


def package(path, comment=b""):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.comment = comment
        with z.open(wz.RECORDS, "w", force_zip64=True) as member:
            member.write(b"0123456789")
        z.writestr(zipfile.ZipInfo(wz.INDEX), "x")
        z.writestr("packed.txt", "y" * 500, compress_type=zipfile.ZIP_DEFLATED)


def test_directories_of_other_writers(tmp_path):
    system = fs.LocalFileSystem()
    for name, comment in (("a.zip", b""), ("b.zip", b"PK with a comment" * 50)):
        package(tmp_path / name, comment)
        members = wz.directory(system, str(tmp_path / name))
        assert set(members) == {wz.RECORDS, wz.INDEX}  # compressed members cannot be range-read
        raw = (tmp_path / name).read_bytes()
        place = members[wz.RECORDS]
        assert raw[place.start:place.start + place.size] == b"0123456789"


def test_zip64_end_record(tmp_path):
    """The same package with its end record moved to the ZIP64 form."""
    package(tmp_path / "a.zip")
    raw = (tmp_path / "a.zip").read_bytes()
    end = raw.rfind(b"PK\x05\x06")
    count, length, start = struct.unpack_from("<HII", raw, end + 10)
    far = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, start)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    (tmp_path / "b.zip").write_bytes(raw[:end] + far + locator + last)
    assert zipfile.ZipFile(io.BytesIO((tmp_path / "b.zip").read_bytes())).namelist()[0] == wz.RECORDS
    assert wz.directory(fs.LocalFileSystem(), str(tmp_path / "b.zip")) == wz.directory(fs.LocalFileSystem(), str(tmp_path / "a.zip"))
