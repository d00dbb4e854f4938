"""Places from raw strings over the nations and regions, with SQL that computes the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places as P
from ..operators import textsearch
from ..registry import query
from ..tables import table

#: Regions are countries here (ids from 1000 on), nations cities inside them; codes C0, C1 ... stand for regions.
_ENTRIES = "(SELECT r_regionkey + 1000 AS id, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation)"


def _gazetteer(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """names, entries and codes."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    none = F.lit(None).cast("bigint")
    country = r.select((F.col("r_regionkey") + 1000).cast("bigint").alias("id"), none.alias("parent_id"), F.lit("country").alias("kind"), F.lit(10**6).cast("bigint").alias("population"), F.col("r_name").alias("name"))
    city = n.select(F.col("n_nationkey").cast("bigint").alias("id"), (F.col("n_regionkey") + 1000).cast("bigint").alias("parent_id"), F.lit("city").alias("kind"), (F.col("n_nationkey") + 1).cast("bigint").alias("population"), F.col("n_name").alias("name"))
    both = country.unionByName(city)
    codes = r.select(F.concat(F.lit("C"), F.char(F.col("r_regionkey") + 65)).alias("code"), F.col("r_name").alias("name"))
    return both.select("name", "id", F.lit("en").alias("locale")), both.drop("name"), codes


def _resolved(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return P.resolve(c.select("c_custkey", text.alias("raw")), "c_custkey", "raw", *_gazetteer(spark, sf_dir))


_CUSTOMERS = "(SELECT c_custkey, n_nationkey AS city, n_regionkey + 1000 AS country, (n_regionkey + 1) % 5 + 1000 AS other FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"""SELECT DISTINCT c_custkey, id FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN city END AS id FROM {_CUSTOMERS} UNION ALL SELECT c_custkey, country FROM {_CUSTOMERS} WHERE c_custkey % 4 = 1 UNION ALL SELECT c_custkey, NULL FROM {_CUSTOMERS} WHERE c_custkey % 4 = 2)""")
def fn_36_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-36: several strings in one value, each once; what matches nothing stays without an id."""
    i = F.col("c_custkey") % 4
    text = F.when(i == 0, F.concat("n_name", F.lit("; "), F.lower("n_name"))).when(i == 1, F.concat("n_name", F.lit("; "), "r_name")).when(i == 2, F.concat("n_name", F.lit(";Nowhere;"))).otherwise("Nowhere at all")
    return _resolved(spark, sf_dir, text).select("c_custkey", "id").distinct()


@query(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN city WHEN 1 THEN country ELSE city END AS id FROM {_CUSTOMERS}")
def fn_37_one_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-37: one string: a city, a country, or both with blanks and slashes."""
    i = F.col("c_custkey") % 3
    text = F.when(i == 0, F.concat(F.lit("  "), F.lower("n_name"), F.lit(" "))).when(i == 1, F.initcap("r_name")).otherwise(F.concat("n_name", F.lit(" / "), "r_name"))
    return _resolved(spark, sf_dir, text).select("c_custkey", "id")


@query(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN country ELSE city END AS id FROM {_CUSTOMERS}")
def fn_38_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-38: codes of countries alone, before a city and behind one."""
    i, code = F.col("c_custkey") % 3, F.concat(F.lit("C"), F.char(F.col("r_regionkey") + 65))
    text = F.when(i == 0, code).when(i == 1, F.concat(code, F.lit("-"), "n_name")).otherwise(F.concat("n_name", F.lit(", "), code))
    return _resolved(spark, sf_dir, text).select("c_custkey", "id")


@query(f"SELECT c_custkey, city AS id FROM {_CUSTOMERS} WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, city FROM {_CUSTOMERS} WHERE c_custkey % 3 = 2 UNION ALL SELECT c_custkey, other FROM {_CUSTOMERS} WHERE c_custkey % 3 = 2")
def fn_39_context_from_the_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-39: what stands to the right gives context where it contains the left; else both are places."""
    i = F.col("c_custkey") % 3
    other = F.element_at(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))), ((F.col("r_regionkey") + 1) % 5 + 1).cast("int"))
    text = F.when(i == 0, F.concat("n_name", F.lit(", "), "r_name")).when(i == 1, F.concat("n_name", F.lit(", Somewhere, "), "r_name")).otherwise(F.concat("n_name", F.lit(", "), other))
    return _resolved(spark, sf_dir, text).select("c_custkey", "id")


def _namesakes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """For each part a region and a city of one name; the city lies inside the region where the size is even; where it is a multiple of 7 a country has the name too."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("place "), "p_partkey").alias("name"))
    row = lambda plus, parent, kind, people: F.struct((F.col("p_partkey") * 10 + plus).alias("id"), parent.cast("bigint").alias("parent_id"), F.lit(kind).alias("kind"), people.cast("bigint").alias("population"))
    none, own = F.lit(None), F.col("p_partkey") * 10
    rows = F.array(row(0, none, "region", F.col("p_size") * 90), row(1, F.when(F.col("p_size") % 2 == 0, own), "city", F.col("p_partkey") % 500 + 1), F.when(F.col("p_size") % 7 == 0, row(2, none, "country", F.lit(1))))
    each = p.select("name", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("e"))
    return each.select("name", F.col("e")["id"].alias("id"), F.lit("en").alias("locale")), each.select("e.*")


@query("""SELECT p_partkey, p_partkey * 10 + CASE WHEN p_size % 7 = 0 THEN 2 WHEN p_size % 2 = 0 THEN CASE WHEN (p_partkey % 500 + 1) * 10 < p_size * 90 THEN 0 ELSE 1 END WHEN p_partkey % 500 + 1 >= p_size * 90 THEN 1 ELSE 0 END AS id FROM part""")
def fn_40_namesakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-40: of namesakes the country; else the city inside its region unless that is ten times larger; else the larger one."""
    names, entries = _namesakes(spark, sf_dir)
    raw = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("Place "), "p_partkey").alias("raw"))
    codes = spark.createDataFrame([], "code string, name string")
    return P.resolve(raw, "p_partkey", "raw", names, entries, codes).select("p_partkey", "id")


@query("SELECT p_partkey, p_partkey * 10 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS id FROM part")
def fn_41_language_tie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-41: of cities with one name, one with the name in the language of the text wins, however small; else the larger one."""
    p = table(spark, sf_dir, "part")
    small = p.select((F.col("p_partkey") * 10 + 1).alias("id"), F.lit(5).cast("bigint").alias("population"), "p_partkey", F.when(F.col("p_size") % 2 == 0, "de").otherwise("fr").alias("locale"))
    large = p.select((F.col("p_partkey") * 10 + 2).alias("id"), F.lit(9).cast("bigint").alias("population"), "p_partkey", F.lit("fr").alias("locale"))
    both = small.unionByName(large)
    names = both.select(F.concat(F.lit("ort "), "p_partkey").alias("name"), "id", "locale")
    entries = both.select("id", F.lit(None).cast("bigint").alias("parent_id"), F.lit("city").alias("kind"), "population")
    raw = p.select("p_partkey", F.concat(F.lit("Ort "), "p_partkey").alias("raw"))
    return P.resolve(raw, "p_partkey", "raw", names, entries, spark.createDataFrame([], "code string, name string"), "de").select("p_partkey", "id")


@query(f"SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE city END AS id FROM {_CUSTOMERS}")
def fn_42_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-42: names with "the" before, "city" behind, or accents that the gazetteer lacks; other words before do not match."""
    i = F.col("c_custkey") % 4
    text = F.when(i == 0, F.concat(F.lit("The "), "n_name")).when(i == 1, F.concat("n_name", F.lit(" City"))).when(i == 2, F.replace(F.initcap("n_name"), F.lit("a"), F.lit("á"))).otherwise(F.concat(F.lit("Xhe "), "n_name"))
    return _resolved(spark, sf_dir, text).select("c_custkey", "id")


# --- suggestions -----------------------------------------------------------------------


@query("""SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda t: levenshtein(t, 'plata') <= 1 OR starts_with(t, 'plata'))) > 0""")
def txt_02_one_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-02: a word with one edit at most; here of a mistyped name."""
    index = textsearch.inverted_index(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return textsearch.matched(index, "p_partkey", ["plata"]).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda t: starts_with(t, 'bo'))) > 0")
def txt_03_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-03: a token that starts with what was typed; two letters allow no edit."""
    index = textsearch.inverted_index(table(spark, sf_dir, "part"), "p_partkey", "p_name")
    return textsearch.matched(index, "p_partkey", ["bo"]).select("p_partkey")


@query("""SELECT p_partkey, greatest(CASE WHEN contains(' ' || p_name, ' red') THEN 3 ELSE 0 END, CASE WHEN contains(lower(p_type), 'red') THEN 2 ELSE 0 END, CASE WHEN contains(lower(p_brand), 'brand#2') THEN 1 ELSE 0 END) AS weight FROM part
 WHERE contains(' ' || p_name, ' red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'brand#2')""")
def txt_04_field_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-04: the best field that matches gives the weight: 3, 2 or 1."""
    hits = [(F.contains(F.concat(F.lit(" "), "p_name"), F.lit(" red")), 3), (F.contains(F.lower("p_type"), F.lit("red")), 2), (F.contains(F.lower("p_brand"), F.lit("brand#2")), 1)]
    return table(spark, sf_dir, "part").select("p_partkey", textsearch.field_weight(hits).alias("weight")).where("weight > 0")


@query("SELECT p_partkey AS id, ['c++', 'c#', '.net', 'c'][p_partkey % 4 + 1] AS name FROM part WHERE p_partkey % 4 IN (0, 1, 3) ORDER BY p_size DESC, p_partkey LIMIT 20")
def txt_05_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-05: technologies by prefix, without typos; signs belong to names (top-k)."""
    name = F.element_at(F.array(*map(F.lit, ("c++", "c#", ".net", "c"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    t = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), "p_size")
    return textsearch.suggest(t, "id", "name", "c", "p_size", 20).select("id", "name")


@query("""WITH h AS (SELECT doc_id, lang, source FROM documents WHERE starts_with(source, 'src1')), f AS (SELECT * FROM h WHERE lang = 'xx')
SELECT doc_id, lang FROM f UNION ALL SELECT doc_id, lang FROM h WHERE lang = 'en' AND NOT EXISTS (SELECT 1 FROM f)""")
def txt_06_english_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-06: suggestions in the wanted language, in English where there is none."""
    hits = table(spark, sf_dir, "documents").where(F.startswith("source", F.lit("src1"))).select("doc_id", "lang")
    return textsearch.in_language(hits, "lang", "xx")


@query("""WITH i AS (SELECT n_nationkey AS id, n_name AS name, 'en' AS locale FROM nation UNION ALL SELECT n_nationkey, 'N_' || n_name, 'de' FROM nation WHERE n_nationkey % 2 = 0)
SELECT id, arg_min(name, CASE locale WHEN 'de' THEN 0 ELSE 1 END) AS name FROM i WHERE contains(lower(name), 'nation_1') GROUP BY 1""")
def txt_08_grouped_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-08: industries whose name in any language matches, one row each, the wanted language first."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    names = n.withColumn("locale", F.lit("en")).unionByName(n.where("id % 2 = 0").select("id", F.concat(F.lit("N_"), "name").alias("name"), F.lit("de").alias("locale")))
    hits = names.where(F.contains(F.lower("name"), F.lit("nation_1")))
    return hits.groupBy("id").agg(F.min_by("name", F.when(F.col("locale") == "de", 0).otherwise(1)).alias("name"))


@query("SELECT n_nationkey AS id, r_name || '/' || n_name AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE starts_with(lower(n_name), 'nation_1') OR starts_with(lower(r_name), 'nation_1') ORDER BY n_nationkey LIMIT 30")
def txt_09_global_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-09: places by prefix with the name of what contains them (top-k)."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    hits = n.where(F.startswith(F.lower("n_name"), F.lit("nation_1"))).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return hits.orderBy("n_nationkey").limit(30).select(F.col("n_nationkey").alias("id"), F.concat_ws("/", "r_name", "n_name").alias("full_name"))


@query("""WITH f AS (SELECT o_custkey AS id, count(*) AS n FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
SELECT c_custkey AS id, coalesce(n, 0) AS n, row_number() OVER (ORDER BY c_custkey % 50 = 7 DESC, coalesce(n, 0) DESC, c_custkey)::INTEGER AS place FROM customer LEFT JOIN f ON c_custkey = id WHERE contains(c_name, '00000') ORDER BY place LIMIT 30""")
def txt_13_company_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-13: companies of a list: name search with facet counts, starred ones first (top-k)."""
    n = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"))
    hits = table(spark, sf_dir, "customer").where(F.contains("c_name", F.lit("00000"))).select(F.col("c_custkey").alias("id")).join(n, "id", "left").fillna(0, ["n"])
    return textsearch.numbered_top(hits, [(F.col("id") % 50 == 7).desc(), F.desc("n"), F.asc("id")], 30)


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier WHERE s_suppkey = 5) AND s_suppkey <> 5 ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def txt_14_similar_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-14: others of the same group, the greatest first (top-k)."""
    s = table(spark, sf_dir, "supplier")
    own = s.where("s_suppkey = 5").select("s_nationkey")
    return s.where("s_suppkey <> 5").join(own, "s_nationkey", "left_semi").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(10).select(F.col("s_suppkey").alias("id"))


@query("""SELECT page_id, 2 * (contains(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), 'the'))::INTEGER + (contains(lower(regexp_extract(html, '(?is)<article>(.*?)</article>', 1)), 'the'))::INTEGER AS score FROM pages""")
def txt_16_title_and_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-16, TXT-18: a word in the title weighs twice one in the description."""
    part = lambda tag: F.contains(F.lower(F.regexp_extract("html", rf"(?is)<{tag}>(.*?)</{tag}>", 1)), F.lit("the")).cast("int")
    return table(spark, sf_dir, "pages").select("page_id", (part("title") * 2 + part("article")).alias("score"))


_TERMS = [("senior", "seniority", "senior"), ("entry level", "seniority", "junior"), ("level", "seniority", "level"), ("c++", "technology", "c++"), ("apache spark", "technology", "spark"), ("spark", "technology", "spark"), ("new york", "place", "new-york"), ("data scientist", "occupation", "data-scientist"), ("scientist", "occupation", "scientist"), ("work from home", "mode", "remote")]


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'seniority=senior;technology=c++' WHEN 1 THEN 'mode=remote;occupation=data-scientist' WHEN 2 THEN 'place=new-york;seniority=junior;technology=spark' ELSE '' END AS filters,
 CASE p_partkey % 4 WHEN 0 THEN 'jobs ' || p_name WHEN 3 THEN p_name || ' work home' ELSE p_name END AS keywords FROM part""")
def txt_12_parse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT-12: free-text queries to filters and keywords, by one join of their word runs with a dictionary."""
    i, name = F.col("p_partkey") % 4, F.col("p_name")
    text = (
        F.when(i == 0, F.concat(F.lit("Senior C++ jobs "), name)).when(i == 1, F.concat(F.lit("work from home, Data Scientist "), name))
        .when(i == 2, F.concat(F.lit("Entry-Level Apache Spark / New York "), name)).otherwise(F.concat(name, F.lit(" work home")))
    )
    terms = spark.createDataFrame(_TERMS, "term string, kind string, value string")
    got = textsearch.parsed(table(spark, sf_dir, "part").select("p_partkey", text.alias("q")), "p_partkey", "q", terms)
    shown = F.array_join(F.transform(F.map_entries("filters"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return got.select("p_partkey", shown.alias("filters"), F.array_join("keywords", " ").alias("keywords"))
