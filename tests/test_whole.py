"""Thin queries on rows that the test tables lack."""

from quaylark import catalogue


def test_rounds_beyond_twelve(spark, tmp_path):
    rows = [(5 * i, 1, "purchase") for i in range(15)] + [(5 * i, 2, "purchase") for i in range(100, 103)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {r["round"]: (r["reached"], r["ended"]) for r in catalogue.queries()["agg_25_funnel_rounds"](spark, str(tmp_path)).collect()}
    assert got == {i: (2 if i <= 3 else 1, int(i in (3, 15))) for i in range(1, 16)}


def test_identity_of_whole_texts(spark, tmp_path):
    rows = [(1, "a" + " " * 600 + "b" * 600), (2, "A" + " " * 600 + "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["identity"] for r in catalogue.queries()["fn_46_identity"](spark, str(tmp_path)).collect()}
    assert got == {1: None, 2: "a b"}
