"""Lists behind shortened display texts are whole."""

from crawlscore.functions import elements as el
from crawlscore.operators import linkgraph as lg
from crawlscore.plans import side_tables as st


def test_all_shots(spark):
    docs = spark.sql("""SELECT 'u' AS final_url, transform(sequence(1, 9), i -> named_struct(
      'tag', 'a', 'path', concat('p', i), 'attrs', map('href', '/x'), 'text', '')) AS elements""")
    (row,) = docs.selectExpr(f"{el.shots('elements', 'final_url')} AS s").collect()
    assert [s.selector for s in row.s] == [f"p{i}" for i in range(1, 10)]


def test_all_pages_of_a_broken_address(spark):
    statuses = spark.createDataFrame([("s", "x", 404), ("s", "y", 200)], "audit_id string, url string, status_code int")
    edges = spark.createDataFrame([("s", u, k, f"p{k}") for u in "xy" for k in range(8)],
                                  "audit_id string, link string, page_key int, final_url string")
    got = lg.broken_pages(statuses, edges, "status_code >= 400").collect()
    assert sorted((r.link, r.final_url) for r in got) == [("x", f"p{k}") for k in range(8)]


def test_all_script_errors_in_full(spark):
    texts = [f"{k}" * 300 for k in range(6)]
    renders = spark.createDataFrame([("s", texts + texts[:2]), ("t", [])], "audit_id string, console_errors array<string>")
    assert sorted(r.error for r in st.script_errors(renders).collect()) == texts
