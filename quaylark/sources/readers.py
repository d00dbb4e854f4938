"""Strict readers for registries, feeds and embedded data."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import rows_of_texts


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """A CSV registry, every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=False)


def read_strict_csv(spark: SparkSession, path: str, columns: list[str], key: str, declared: int | None = None) -> DataFrame:
    """A CSV with exactly these columns, no malformed line, no repeated key and, if declared, that many rows."""
    header = spark.read.text(path).limit(1).first()
    if header is None or header[0].split(",") != columns:
        raise ValueError(f"header is not {columns}")
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", enforceSchema=True)
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"repeated {key}: {[r[0] for r in twice]}")
    if declared is not None and (n := df.count()) != declared:
        raise ValueError(f"{n} rows, {declared} declared")
    return df


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; a malformed line ends the read."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_frames(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines parted by LF only, so that other line ends inside strings stay."""
    return spark.read.text(path, lineSep="\n").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("v.*")


def lenient(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast where they can be, null where not; other columns are not read."""
    return df.select(*[F.col(c).try_cast(t).alias(c) for c, t in types.items()])


def wide_to_long(df: DataFrame, key: str, locales: list[str], aliases: str) -> DataFrame:
    """One column a locale, and aliases parted by |, to (key, locale, name, is_alias)."""
    names = df.unpivot([key], locales, "locale", "name").where("name IS NOT NULL AND trim(name) <> ''").withColumn("is_alias", F.lit(False))
    more = df.select(key, F.lit("any").alias("locale"), F.explode(F.split(F.col(aliases), r"\|")).alias("name")).where("trim(name) <> ''").withColumn("is_alias", F.lit(True))
    return names.unionByName(more)


# --- XML ---------------------------------------------------------------------------


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True)
    return (reader.schema(schema) if schema else reader).load(path)


def sitemap_locations(xml: Column) -> Column:
    """All <loc> values of a sitemap or sitemap index, entities decoded."""
    found = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:\w+:)?loc>\s*(.*?)\s*</(?:\w+:)?loc>"), F.lit(1))
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def feed_items(xml: Column) -> Column:
    """array<struct<title,link>> of RSS items or Atom entries."""
    items = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:item|entry)\b.*?</(?:item|entry)>"), F.lit(0))
    tag = lambda i, t: F.regexp_replace(F.regexp_extract(i, rf"(?s)<{t}\b[^>]*>\s*(.*?)\s*</{t}>", 1), r"^<!\[CDATA\[|\]\]>$", "")
    return F.transform(items, lambda i: F.struct(tag(i, "title").alias("title"), F.coalesce(F.nullif(tag(i, "link"), F.lit("")), F.regexp_extract(i, r'<link[^>]*href="([^"]*)"', 1)).alias("link")))


def euro_rates(xml: Column) -> Column:
    """array<struct<currency,to_eur>> of a reference rate sheet, to 12 places."""
    found = F.regexp_extract_all(xml, F.lit(r"currency=['\"]([A-Z]{3})['\"]\s+rate=['\"]([0-9.]+)['\"]"), F.lit(0))
    rate = lambda s: F.regexp_extract(s, r"rate=['\"]([0-9.]+)", 1).cast("decimal(20,8)")
    return F.transform(found, lambda s: F.struct(F.regexp_extract(s, r"currency=['\"]([A-Z]{3})", 1).alias("currency"), F.round(F.lit(1).cast("decimal(20,12)") / rate(s), 12).alias("to_eur")))


# --- HTML --------------------------------------------------------------------------


HREF = r"""(?i)<a\s[^>]*href\s*=\s*["']([^"'#][^"']*)["']"""


def links(html: Column) -> Column:
    """All href values of a page, each once, entities decoded."""
    found = F.regexp_extract_all(html, F.lit(HREF), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&"))))


POSTING = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "company", "employment_type", "date_posted", "currency", "least", "most", "unit")])
_LD = re.compile(r"<script[^>]*application/ld\+json[^>]*>(.*?)</script", re.I | re.S)
#: Fixed order in which one of several employment types is chosen.
_TYPES = ("FULL_TIME", "PART_TIME", "CONTRACTOR", "TEMPORARY", "INTERN", "VOLUNTEER")


def _find(node: object) -> dict | None:
    """The first JobPosting of a document: itself, in a list, or in the graph of another object."""
    if isinstance(node, list):
        return next((f for x in node if (f := _find(x))), None)
    if not isinstance(node, dict):
        return None
    kind = node.get("@type")
    if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
        return node
    return _find(node.get("@graph"))


def _loads(raw: str) -> object:
    body = re.sub(r"^\s*(<!\[CDATA\[|<!--)|(\]\]>|-->)\s*$", "", raw.strip())
    try:
        return json.loads(body)
    except ValueError:
        try:
            return json.loads(re.sub(r"[\x00-\x1f]", " ", body))
        except ValueError:
            return None


def posting_of(html: str | None) -> dict[str, str | None]:
    """JobPosting fields of a page; all null where there is none."""
    found = next((p for raw in _LD.findall(html or "") if (p := _find(_loads(raw)))), None)
    out: dict[str, str | None] = dict.fromkeys(POSTING.names)
    if not found:
        return out
    text = lambda v: None if v is None or isinstance(v, (dict, list)) else str(v)
    kinds = found.get("employmentType")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    pay = found.get("baseSalary")
    pay = pay if isinstance(pay, dict) else {}
    value = pay.get("value")
    value = value if isinstance(value, dict) else {"value": value}
    one = value.get("value")
    company = found.get("hiringOrganization")
    return {
        "title": text(found.get("title")),
        "company": text(company.get("name") if isinstance(company, dict) else company),
        "employment_type": next((k for k in _TYPES if k in kinds), text(kinds[0])),
        "date_posted": text(found.get("datePosted")),
        "currency": text(pay.get("currency")),
        "least": text(value.get("minValue", one)),
        "most": text(value.get("maxValue", one)),
        "unit": text(value.get("unitText", pay.get("unitText"))),
    }


@F.pandas_udf(POSTING)
def _posting(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([posting_of(h) for h in html], columns=POSTING.names, dtype=object)


def json_ld_postings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, fields...) of pages with a JobPosting; pages without one never reach Python."""
    may = pages.where(F.col(html).contains("ld+json") & F.col(html).contains("JobPosting"))
    return may.select(key, _posting(F.col(html)).alias("p")).select(key, "p.*").where("title IS NOT NULL")


def balanced_json(text: str | None, marker: str) -> str | None:
    """The JSON value behind a marker such as ``window.state =``: braces inside strings do not count."""
    at = (text or "").find(marker)
    if at < 0:
        return None
    start = re.search(r"[\[{]", text[at + len(marker) :])
    if not start:
        return None
    begin = at + len(marker) + start.start()
    try:
        return json.dumps(json.JSONDecoder().raw_decode(text[begin:])[0], sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


def embedded_json(pages: DataFrame, key: str, html: str, marker: str) -> DataFrame:
    """(key, payload): the embedded JSON of each page that has the marker."""

    def take(page: str | None) -> list[tuple[str]]:
        found = balanced_json(page, marker)
        return [] if found is None else [(found,)]

    marked = pages.where(F.col(html).contains(marker))
    return rows_of_texts(marked, key, html, T.StructType([T.StructField("payload", T.StringType())]), take)


# --- paging and merging ------------------------------------------------------------


def new_pages(items: DataFrame, page: str, seen_at: str, watermark: Column, safety: int) -> DataFrame:
    """Items of the pages up to ``safety`` pages behind the first page that is wholly old."""
    first_old = items.groupBy(page).agg(F.max(seen_at).alias("m")).where(F.col("m") <= watermark).agg(F.min(page).alias("stop"))
    return items.crossJoin(F.broadcast(first_old)).where(F.col("stop").isNull() | (F.col(page) < F.col("stop") + safety)).drop("stop")


def merge_locales(feeds: DataFrame, key: str, locale: str, fields: list[str], primary: str) -> DataFrame:
    """One row a key: the primary language's fields (back-filled from the others), and a map of all languages."""
    value = F.struct(*fields)
    by = feeds.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(locale).alias("key"), value.alias("value")))).alias("e"),
        *[F.coalesce(F.max(F.when(F.col(locale) == primary, F.col(c))), F.min_by(c, F.when(F.col(c).isNotNull(), F.col(locale)))).alias(c) for c in fields],
    )
    return by.select(key, *fields, F.map_from_entries("e").alias("localizations"))


def assert_complete(found: int, advertised: int) -> None:
    """Fail a cycle that found fewer than advertised without 1 % (one row at least)."""
    if found < advertised - max(1, -(-advertised // 100)):
        raise ValueError(f"found {found} of {advertised}")


def best_detector(df: DataFrame, rules: list[tuple[str, int, Column]]) -> DataFrame:
    """The cheapest rule that can handle a row."""
    out = F.lit(None).cast("string")
    for name, _, can in sorted(rules, key=lambda r: -r[1]):
        out = F.when(can, name).otherwise(out)
    return df.withColumn("monitor", out)


def scored_arrays(payload: DataFrame, key: str, column: str, source: str) -> DataFrame:
    """Arrays inside JSON payloads, the likeliest list of postings of each source first: objects with titles and links."""
    items = F.from_json(F.get_json_object(F.col(column), "$.items"), "array<map<string,string>>")
    score = F.aggregate(items, F.lit(0), lambda a, m: a + F.when(F.array_contains(F.map_keys(m), "title"), 2).otherwise(0) + F.when(F.array_contains(F.map_keys(m), "url"), 1).otherwise(0))
    w = Window.partitionBy(source).orderBy(F.desc("score"), key)
    return payload.select(key, source, score.alias("score")).where("score > 0").withColumn("rank", F.row_number().over(w))


#: Where the page state of a framework begins.
FRAMEWORKS = (("next", r'<script id="__NEXT_DATA__"[^>]*>\s*'), ("router", r"window\.__(?:remixContext|reactRouterContext)\s*=\s*"), ("flight", r"self\.__next_f\.push\("))


def framework_payloads(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, framework, payload): the JSON value behind the first framework marker of each page."""
    found = F.lit(None).cast("struct<framework:string,rest:string>")
    for name, mark in reversed(FRAMEWORKS):
        rest = F.regexp_extract(F.col(html), "(?s)" + mark + "(.*)", 1)
        found = F.when(F.col(html).rlike(mark), F.struct(F.lit(name).alias("framework"), rest.alias("rest"))).otherwise(found)
    rows = pages.select(key, found.alias("f")).where("f IS NOT NULL")
    return rows.select(key, "f.framework", _json_value("f.rest").alias("payload")).where("payload IS NOT NULL")


@F.pandas_udf(T.StringType())
def _leading_json(text: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(raw: str | None) -> str | None:
        try:
            return json.dumps(decoder.raw_decode(raw or "")[0], separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return text.map(first)


def _json_value(column: str) -> Column:
    """The JSON value at the start of a text, compact; null where there is none."""
    return _leading_json(F.col(column))


def chosen_facet(counts: DataFrame) -> DataFrame:
    """(source, facet): of rows (source, facet, value, n, cap) the facet with most values, none of them at the cap or above."""
    by = counts.groupBy("source", "facet").agg(F.count("*").alias("k"), F.max("n").alias("top"), F.max("cap").alias("cap"))
    return by.where("top < cap").groupBy("source").agg(F.max_by("facet", F.struct("k", "facet")).alias("facet"))


def filled_buckets(counts: DataFrame, source: str, value: str, n: str, cap: str) -> DataFrame:
    """(source, value, place, bucket): values of each source in their order, filled greedily into buckets below the cap.

    A value of unknown size (null) stands alone. The fold carries one row a value of one
    source: facets have few values, however many rows they count.
    """
    zero = F.struct(F.lit(0).alias("bucket"), F.lit(0).cast("bigint").alias("size"), F.lit(True).alias("full"), F.array().cast("array<struct<value:string,bucket:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = x["n"].isNull() | acc["full"] | (acc["size"] + x["n"] >= F.col("_cap"))
        bucket = acc["bucket"] + new.cast("int")
        row = F.struct(x["v"].cast("string").alias("value"), bucket.alias("bucket"))
        return F.struct(bucket.alias("bucket"), F.coalesce(F.when(new, x["n"]).otherwise(acc["size"] + x["n"]), F.lit(0)).cast("bigint").alias("size"), x["n"].isNull().alias("full"), F.concat(acc["out"], F.array(row)).alias("out"))

    ordered = F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(n).cast("bigint").alias("n"))))
    by = counts.groupBy(source).agg(ordered.alias("all"), F.max(cap).alias("_cap"))
    return by.select(source, F.posexplode(F.aggregate("all", zero, step, lambda acc: acc["out"])).alias("at", "b")).select(source, "b.value", (F.col("at") + 1).cast("bigint").alias("place"), "b.bucket")


#: Names that keys of a posting usually have, the likelier first.
USUAL_KEYS = {"title": ("title", "jobTitle", "name", "position"), "url": ("url", "applyUrl", "link", "href"), "location": ("location", "city", "locationName")}


def auto_mapped(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, title, url, location) of JSON objects of unknown shape."""
    first = lambda names: F.coalesce(*[F.get_json_object(F.col(body), f"$.{n}") for n in names])
    return rows.select(key, *[first(names).alias(field) for field, names in USUAL_KEYS.items()])
