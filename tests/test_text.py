"""Extraction, parsing and readers on fixed inputs."""

import pytest
from pyspark.sql import functions as F

from quaylark.functions import extract, queryparse
from quaylark.operators import filters, hierarchy, textsearch
from quaylark.plans.texts import DICTIONARIES
from quaylark.sources import readers


def test_blocks_never_fail():
    page = "<html><head><style>p{}</style><script>var t='</p>'</script></head><body><h1>A &amp; B</h1><p>one<br>two<ul><li>x</li></ul></div></p>tail<nav>no</nav>"
    assert extract.html_blocks(page) == [("h2", "A & B"), ("p", "one two"), ("li", "x"), ("p", "tail")]
    assert extract.html_blocks(None) is None
    assert extract.html_blocks("") == []
    assert extract.html_blocks("&lt;p&gt;hi&lt;/p&gt;") == [("p", "hi")]
    for broken in ("<", "<p", "<![", "</", "<!--", "<a href='", "&#xZZ;"):
        extract.html_blocks(broken)


def test_parse_query():
    p = queryparse.parse("Senior Python engineer in Berlin, work from home", DICTIONARIES)
    assert p.found == {"mode": ["remote"], "seniority": ["senior"], "technology": ["python"], "place": ["berlin"], "occupation": ["engineer"]}
    assert p.keywords == ["in"]
    assert queryparse.parse(None, DICTIONARIES).found == {}


def test_filter_canonical_form_and_invalid_values():
    f = filters.PostingFilter(employment=["full_time", "nonsense"], modes=["remote"], salary=(0, None))
    assert f.canonical()["employment"] == ["full_time", "nonsense"]
    assert filters.PostingFilter(locations=[2, 1]).canonical() == filters.PostingFilter(locations=[1, 2, 2]).canonical()


def test_posting_filter_clauses(spark):
    rows = [(1, True, None, [5], ["remote"], ["en"], -1, -1, 50_000), (2, True, False, [5], ["remote"], ["en"], 2, 4, 50_000), (3, False, True, [6], ["onsite"], ["_none"], 2, 99, 90_000), (4, True, True, [5, 6], [], ["_none"], 8, 10, None)]
    df = spark.createDataFrame(rows, "id int, is_active boolean, has_content boolean, location_ids array<int>, location_types array<string>, locales array<string>, experience_min int, experience_max int, salary int")
    df = df.withColumns({"occupation_ids": F.array().cast("array<int>"), "technology_ids": F.array().cast("array<string>"), "seniority": F.lit("x"), "employment_type": F.lit("full_time"), "company_id": F.lit(1)})
    ids = lambda **k: [r["id"] for r in df.where(filters.PostingFilter(**k).column()).orderBy("id").collect()]
    assert ids() == [1, 4]
    assert ids(snapshot=False) == [1, 3, 4]
    assert ids(modes=["remote"]) == [1]
    assert ids(languages=["de"]) == [4]
    assert ids(experience=(3, 5)) == [1]
    assert ids(salary=(40_000, None)) == [1]
    assert ids(locations=[6], snapshot=False) == [3, 4]
    assert ids(modes=["nonsense"]) == [1, 4]  # unknown values are dropped


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, parent_id long")
    got = hierarchy.closure(edges, max_hops=3).collect()
    assert max(r["depth"] for r in got) == 3


def test_strict_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("slug,url\na,http://a\nb,http://b\n")
    assert readers.read_strict_csv(spark, str(good), ["slug", "url"], "slug", 2).count() == 2
    with pytest.raises(ValueError, match="declared"):
        readers.read_strict_csv(spark, str(good), ["slug", "url"], "slug", 3)
    with pytest.raises(ValueError, match="header"):
        readers.read_strict_csv(spark, str(good), ["url", "slug"], "slug")
    twice = tmp_path / "twice.csv"
    twice.write_text("slug,url\na,http://a\na,http://b\n")
    with pytest.raises(ValueError, match="repeated"):
        readers.read_strict_csv(spark, str(twice), ["slug", "url"], "slug")
    assert readers.read_registry(spark, str(good)).dtypes == [("slug", "string"), ("url", "string")]


def test_jsonl(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_jsonl(spark, str(path), "a int").count() == 2
    assert readers.read_frames(spark, str(path), "a int").agg(F.sum("a")).first()[0] == 3
    path.write_text('{"a": 1}\n{broken\n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(path), "a int").collect()


def test_xml(spark, tmp_path):
    path = tmp_path / "x.xml"
    path.write_text("<urlset><url><loc>https://a</loc></url><url><loc>https://b</loc></url></urlset>")
    assert sorted(r["loc"] for r in readers.read_xml(spark, str(path), "url", "loc string").collect()) == ["https://a", "https://b"]


def test_completeness():
    readers.assert_complete(99, 100)
    readers.assert_complete(990, 1000)
    with pytest.raises(ValueError):
        readers.assert_complete(989, 1000)


def test_queries_are_never_broadcast(spark):
    """However small Spark takes the queries for, only the dictionary goes to all tasks."""
    queries = spark.range(1000).selectExpr("id", "'Senior Apache Spark, ' || id AS q")
    terms = spark.createDataFrame([("senior", "seniority", "senior"), ("apache spark", "technology", "spark"), ("spark", "technology", "other")], "term string, kind string, value string")
    got = textsearch.parsed(queries, "id", "q", terms)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") == 1 and "Inner, BuildRight" in plan, plan
    rows = got.collect()
    assert len(rows) == 1000
    assert all(r["filters"] == {"seniority": ["senior"], "technology": ["spark"]} and r["keywords"] == [str(r["id"])] for r in rows)
