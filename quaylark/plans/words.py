"""Text, titles, enumerations, URLs, hashes and embedded data over table rows, with SQL that computes the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dictionary, experience, extract, scalars as S
from ..operators import filters
from ..registry import query
from ..sources import readers
from ..tables import table


def _cycled(n: Column, values: list[str]) -> Column:
    """One of the values for each number, in turn."""
    return F.try_element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pairs(key: str, tab: str, cases: list[tuple[str, str | None]], raw: str, out: str) -> str:
    """SQL: the second of a pair for each row, pairs in turn."""
    n = len(cases)
    return f"SELECT {key}, ({_list([c for c, _ in cases])})[{key} % {n} + 1] AS {raw}, ({_list([v for _, v in cases])})[{key} % {n} + 1] AS {out} FROM {tab}"


# --- text ------------------------------------------------------------------------------


@query("SELECT p_partkey, replace(replace(p_name, 'e', 'é'), 'o', 'ö') AS fixed FROM part")
def fn_02_mojibake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-02: wrongly decoded names repaired; names without any such sign stay."""
    broken = F.replace(F.replace("p_name", F.lit("e"), F.lit("Ã©")), F.lit("o"), F.lit("Ã¶"))
    return table(spark, sf_dir, "part").select("p_partkey", S.unmojibake(broken).alias("fixed"))


@query("""
WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) > 0),
c AS (SELECT doc_id, text, n, 0 AS i, 0::BIGINT AS start, CASE WHEN n <= 500 THEN n ELSE (CASE WHEN 500 - strpos(reverse(substr(text, 1, 500)), ' ') > 0 AND strpos(reverse(substr(text, 1, 500)), ' ') > 0 THEN 500 - strpos(reverse(substr(text, 1, 500)), ' ') ELSE 500 END) END AS size FROM t
 UNION ALL
 SELECT doc_id, text, n, i + 1, start + size + 1, CASE WHEN n <= start + size + 1 + 500 THEN n - (start + size + 1) ELSE (CASE WHEN 500 - strpos(reverse(substr(text, start + size + 2, 500)), ' ') > 0 AND strpos(reverse(substr(text, start + size + 2, 500)), ' ') > 0 THEN 500 - strpos(reverse(substr(text, start + size + 2, 500)), ' ') ELSE 500 END) END
 FROM c WHERE start + 500 < n AND start + size + 1 < n)
SELECT doc_id, i, md5(substr(text, start + 1, size)) AS digest FROM c""")
def fn_09_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-09: whole texts in pieces of up to 500 characters, cut at the last blank before the limit."""
    c = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.posexplode(S.chunks(F.col("text"))).alias("i", "c"))
    return c.select("doc_id", "i", F.md5("c").alias("digest"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN floor(o_totalprice / 1000) * 1000 ELSE floor(o_totalprice) + CASE WHEN o_orderkey % 4 = 3 THEN 0 ELSE 0.25 END END::DOUBLE AS value FROM orders""")
def fn_20_locale_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-20: amounts as several locales write them."""
    whole = F.floor("o_totalprice")
    n, grouped = F.col("o_orderkey") % 4, F.format_number(whole, 0)
    raw = (
        F.when(n == 0, F.concat(F.replace(grouped, F.lit(","), F.lit(".")), F.lit(",25")))
        .when(n == 1, F.concat(grouped, F.lit(".25")))
        .when(n == 2, F.concat(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lit("K")))
        .otherwise(F.replace(grouped, F.lit(","), F.lit("'")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", S.decimal_number(raw).alias("value"))


_UNITS = [("per hour", "hour"), ("Annual", "year"), ("monthly", "month"), ("per-day-rate", "day"), ("WEEK", "week"), ("per annum", "year"), ("two_weeks", "week"), ("per-hour-wage", "hour"), ("lump sum", None), ("hr", "hour")]


@query(_pairs("p_partkey", "part", _UNITS, "raw", "period"))
def fn_21_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-21, FN-35: pay periods by exact name, else by what they contain in a fixed order."""
    raw = _cycled(F.col("p_partkey"), [u for u, _ in _UNITS])
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), S.salary_period(raw).alias("period"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))), '[^a-z0-9+#. ]+', ' ', 'g'), ' +', ' ', 'g')) AS key FROM pages")
def fn_31_title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-31: titles of pages in normal form, with gender markers added and taken off again."""
    title = F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)
    marked = F.concat(title, _cycled(F.col("page_id"), ["", " (m/w/d)", " (h/f)", " (F/M/X)", " (all genders)"]))
    return table(spark, sf_dir, "pages").select("page_id", S.title_key(marked).alias("key"))


_LEVELS = [
    ("Senior %", "senior"), ("Sr. %", "senior"), ("Junior %", "entry"), ("Jr %", "entry"), ("Principal %", "principal"), ("Distinguished %", "principal"), ("Staff %", "staff"), ("Lead %", "lead"), ("Lead Generation %", None),
    ("Team Lead %", "lead"), ("Head of %", "director"), ("Overhead %", None), ("Director of %", "director"), ("Art Director of %", None), ("VP %", "director"), ("Chief % Officer", None), ("CTO %", "executive"),
    ("Geschäftsführerin (m/w/d) %", "executive"), ("% Intern", "intern"), ("Internal % Auditor", None), ("Praktikant/in %", "intern"), ("Working Student, %", "intern"), ("CIO Advisory %", None), ("Graduate Program %", "entry"), ("%", None), ("% (Senior)", None),
]


@query("SELECT p_partkey, (" + _list([v for _, v in _LEVELS]) + f")[p_partkey % {len(_LEVELS)} + 1] AS level FROM part")
def fn_32_seniority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-32: levels of titles made from names; a wrong level is worse than none."""
    title = F.replace(_cycled(F.col("p_partkey"), [t for t, _ in _LEVELS]), F.lit("%"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", S.seniority(title).alias("level"))


_KINDS = [("Full-Time", "full_time"), (" TEILZEIT ", "part_time"), ("per_diem", "part_time"), ("Freelancer", "contract"), ("co-op", "internship"), ("full_time, part_time", "full_or_part"), ("tempo pieno", "full_time"), ("CDD", "contract"), ("全职", "full_time"), ("gig", None), ("voluntary", "volunteer")]


@query(_pairs("p_partkey", "part", _KINDS, "raw", "kind"))
def fn_33_employment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-33: types of employment in several languages; unknown ones give null."""
    raw = _cycled(F.col("p_partkey"), [k for k, _ in _KINDS])
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), S.employment_type(raw).alias("kind"))


_SPOTS = [("Remote (EU only)", "remote"), ("on-site", "onsite"), ("HYBRID", "hybrid"), ("Onsite (5 Days per Week)", "onsite"), ("home office", "remote"), ("beach (sunny)", None), ("télétravail", "remote")]


@query(_pairs("p_partkey", "part", _SPOTS, "raw", "kind"))
def fn_34_location_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-34: types of work place, a note in brackets aside."""
    raw = _cycled(F.col("p_partkey"), [k for k, _ in _SPOTS])
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), S.location_type(raw).alias("kind"))


@query("""
WITH terms AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[a-z]{7,}')) AS term FROM benchmark),
words AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS term FROM documents)
SELECT doc_id, count(*) AS n_found, md5(string_agg(term, ',' ORDER BY term)) AS found FROM words JOIN terms USING (term) GROUP BY doc_id""")
def fn_28_technologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-28: terms of a dictionary (the long words of the benchmark items) between borders in whole documents, one pass a text."""
    terms = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]{7,}"), F.lit(0))).alias("term")).distinct()
    found = dictionary.with_terms(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", terms.select(F.col("term").alias("slug"), "term", F.lit(False).alias("capitals")))
    return found.where(F.size("terms") > 0).select("doc_id", F.size("terms").cast("long").alias("n_found"), F.md5(F.array_join("terms", ",")).alias("found"))


@query("SELECT p_partkey, regexp_matches(p_name, '(^|[^a-z])bolt($|[^a-z])') AS bolt, contains(p_name || '+ ', 'anvil+ ') AS plus FROM part")
def fn_29_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-29: borders beside words and beside symbols."""
    name = F.concat("p_name", F.lit("+ "))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").rlike(S.border("bolt")).alias("bolt"), name.rlike(S.border(r"anvil\+")).alias("plus"))


_ALIASES = [("small widget", "small-widget"), ("widget", "widget"), ("bolt", "bolt"), ("extra large red anvil", "large-bolt"), ("special widget", "special")]


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'large-bolt' WHEN p_partkey % 5 = 1 THEN 'special'
 WHEN contains(' ' || p_name || ' ', ' special widget ') THEN 'special' WHEN contains(' ' || p_name || ' ', ' small widget ') THEN 'small-widget' WHEN contains(' ' || p_name || ' ', ' widget ') THEN 'widget' WHEN contains(' ' || p_name || ' ', ' bolt ') THEN 'bolt' END AS occupation FROM part""")
def fn_30_occupation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-30: the whole title, else the longest alias between borders, else all words of a long alias in any order."""
    i = F.col("p_partkey") % 5
    title = F.when(i == 0, "large red thing that is extra strong as an anvil").when(i == 1, "special widget").otherwise(F.col("p_name"))
    aliases = spark.createDataFrame(_ALIASES, "alias string, slug string")
    return extract.with_occupation(table(spark, sf_dir, "part").select("p_partkey", title.alias("title")), "p_partkey", "title", aliases).select("p_partkey", "occupation")


@query("""SELECT o_orderkey AS id, a::DOUBLE AS low, (CASE WHEN k = 1 THEN b END)::DOUBLE AS high FROM (SELECT o_orderkey, o_orderkey % 4 AS k, (o_orderkey % 37)::INTEGER AS a, least(o_orderkey % 37 + 2, 30)::INTEGER AS b FROM orders) WHERE k < 3 AND a <= 30""")
def fn_26_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-26: years asked for, as a minimum, a range or with a word behind; the highest of several, company history aside."""
    k, a = F.col("o_orderkey") % 4, F.col("o_orderkey") % 37
    low, high, less = a.cast("string"), F.least(a + 2, F.lit(30)).cast("string"), F.greatest(a - 3, F.lit(0)).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("Founded 29 years ago. At least "), low, F.lit(" years with tools; over "), less, F.lit(" years of sales.")))
        .when(k == 1, F.concat(F.lit("You bring "), low, F.lit(" - "), high, F.lit("+ years")))
        .when(k == 2, F.concat(low, F.lit("+ Jahre einschlägige Erfahrung, mindestens "), less, F.lit(" Jahre Vertrieb")))
        .otherwise(F.concat(F.lit("Our company has a history of "), low, F.lit(" years of experience")))
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), a.alias("a"))
    return experience.with_experience(rows.where("a <= 30"), "text").where("experience IS NOT NULL").select("id", "experience.low", "experience.high")


@query("SELECT p_partkey, '<p>' || p_type || ':</p><ul><li>' || replace(p_name, ' ', '</li><li>') || '</li></ul><p>Apply</p>' AS html FROM part")
def fn_58_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-58: plain text with bullets to paragraphs and a list."""
    text = F.concat("p_type", F.lit(":\n- "), F.replace("p_name", F.lit(" "), F.lit("\n* ")), F.lit("\n\nApply"))
    return table(spark, sf_dir, "part").select("p_partkey", extract.bullets(text).alias("html"))


@query("SELECT doc_id, lang AS tag FROM documents WHERE lang IS NOT NULL")
def fn_65_primary_subtag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-65: primary subtags of locales in several spellings."""
    raw = F.concat(F.lit(" "), F.upper("lang"), _cycled(F.col("doc_id"), ["-CH", "_us", "", "-Latn-x"]), F.lit(" "))
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", S.primary_subtag(raw).alias("tag"))


@query("""SELECT event_id, CASE WHEN s >= 31536000 THEN (s // 31536000) || 'y' WHEN s >= 2592000 THEN (s // 2592000) || 'mo' WHEN s >= 604800 THEN (s // 604800) || 'w' WHEN s >= 86400 THEN (s // 86400) || 'd' WHEN s >= 3600 THEN (s // 3600) || 'h' ELSE greatest(s // 60, 1) || 'm' END AS label
FROM (SELECT event_id, event_id * event_id * 61 AS s FROM events)""")
def fn_67_relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-67: how long ago, in the greatest unit that fits."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * F.col("event_id") * 61).alias("s"))
    return e.select("event_id", S.relative_label(F.col("s")).alias("label"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN round_even(a / 1000, 0)::BIGINT || 'k–' || floor((a + 10000) / 1000 + 0.5)::BIGINT || 'k EUR' WHEN 1 THEN floor(a / 1000 + 0.5)::BIGINT || 'k+ USD' WHEN 2 THEN '≤' || h || ' CHF / hour' ELSE '' END AS label
FROM (SELECT o_orderkey, (o_orderkey % 90 * 1000 + 10000)::DOUBLE AS a, o_orderkey % 90 + 5 AS h FROM orders)""".replace("round_even(a / 1000, 0)::BIGINT", "floor(a / 1000 + 0.5)::BIGINT"))
def fn_68_salary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-68: pay as it is shown: thousands as k, open ends, hourly amounts from hundredths."""
    k, n = F.col("o_orderkey") % 4, F.col("o_orderkey") % 90
    least = F.when(k < 2, n * 1000 + 10_000)
    most = F.when(k == 0, n * 1000 + 20_000).when(k == 2, (n + 5) * 100)
    currency = F.when(k == 1, "USD").when(k == 2, "CHF")
    period = F.when(k == 2, "hour").otherwise("year")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), S.salary_label(least, most, currency, period).alias("label"))


_RANKS = [("compliance specialist", "Head of Risk", False), ("compliance specialist", "senior", True), ("compliance officer", "head of", True), ("market analyst", "Assistant Vice President", True), ("plant operator", "Manager", False), (None, "director", True), ("data analyst", None, True)]


@query(f"SELECT p_partkey, ([{', '.join(str(r[2]).upper() for r in _RANKS)}])[p_partkey % {len(_RANKS)} + 1] AS ok FROM part")
def fn_66_ranks_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-66: a subordinate rank in the profession beside leadership in the seniority is a mistake."""
    pick = lambda i: F.element_at(F.array(*[F.lit(r[i]).cast("string") for r in _RANKS]), (F.col("p_partkey") % len(_RANKS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", S.ranks_agree(pick(0), pick(1)).alias("ok"))


_BAD = ["Page Not Found", " 404 ", "sign in", "Redirecting"]


@query("SELECT p_partkey, p_partkey % 6 < 4 AS garbage FROM part")
def flt_22_garbage_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-22: titles of login, error and redirect pages among names."""
    title = F.coalesce(_cycled(F.col("p_partkey") % 6, [*_BAD, "", ""]), F.lit(""))
    title = F.when(F.col("p_partkey") % 6 < 4, title).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", filters.garbage_title(title).alias("garbage"))


@query("""SELECT user_id, '{"languages":' || to_json(list_sort(list_distinct(list(event_type)))) || ',"locations":[' || array_to_string(list_sort(list_distinct(list(event_id % 9))), ',') || ']}' AS canonical FROM events GROUP BY 1""")
def flt_11_canonical_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-11: stored filters with sorted values under a fixed order of keys: equal filters give equal texts."""
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("languages"), F.collect_list(F.col("event_id") % 9).alias("locations"))
    return by.select("user_id", filters.canonical_json({"locations": F.col("locations"), "languages": F.col("languages")}).alias("canonical"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_partkey % 3 WHEN 0 THEN 'apfel ' WHEN 1 THEN 'item ' ELSE 'ubung ' END, p_size, p_partkey)::INTEGER AS position FROM part""")
def srt_10_display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-10: base letters without accents and case, numbers by value, within each brand."""
    name = F.concat(_cycled(F.col("p_partkey"), ["Äpfel ", "item ", "Übung "]), F.col("p_size").cast("string"))
    w = Window.partitionBy("p_brand").orderBy(filters.display_key(name), "p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", F.row_number().over(w).alias("position"))


# --- URLs and hashes -------------------------------------------------------------------


@query(r"""SELECT page_id, split_part(url, '#', 1) || CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS url FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://jobs.successfactors.eu/c?company=' || page_id || '&career=1' WHEN 1 THEN 'https://x.tal.net/brand-1/opp/' || page_id ELSE url END AS url FROM pages)""")
def fn_43_session_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-43: session parts out of URLs of the hosts that put them in; other URLs stay."""
    i = F.col("page_id").cast("string")
    raw = (
        F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://jobs.successfactors.eu/c?company="), i, F.lit("&_s.crb=a%2Fb&career=1&browserTimeZone=x")))
        .when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://x.tal.net/brand-1/xf-0a9f/opp/"), i))
        .otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", S.without_session(raw).alias("url"))


@query(r"""SELECT page_id, 'https://' || lower(split_part(split_part(url, '//', 2), '/', 1)) || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*(/[^?#]*)', 1), '/+$', '') ||
 CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS canonical FROM (SELECT page_id, url, list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|ref=|gclid=|fbclid=|page=)'))) AS k FROM pages)""")
def fn_43_canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-43: one form of each page URL, without tracking and page parameters."""
    return table(spark, sf_dir, "pages").select("page_id", S.canonical_url(F.col("url")).alias("canonical"))


@query("SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS domain FROM pages")
def fn_56_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-56: the domain of a URL."""
    return table(spark, sf_dir, "pages").select("page_id", S.domain(F.col("url")).alias("domain"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://jobs.x' || page_id || '.org/a?b=2&c=1' WHEN 1 THEN 'https://x' || page_id || '.org:8080/' WHEN 2 THEN 'https://x.org/p/' || page_id END AS url FROM pages""")
def fn_44_board_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-44: board URLs in normal form; URLs with credentials or another scheme are none."""
    i = F.col("page_id").cast("string")
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit(" HTTP://Jobs.X"), i, F.lit(".org.:80/a/?c=1&utm_a=x&b=2&GCLID=9#top "))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("https://x"), i, F.lit(".org:8080"))).when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://x.org:443/p/"), i, F.lit("//"))).otherwise(F.concat(F.lit("https://me:pw@x.org/"), i))
    return table(spark, sf_dir, "pages").select("page_id", S.board_url(raw).alias("url"))


@query()
def fn_44_word_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-44: every distinct word of letters in any document as a host, those beyond ASCII in Punycode."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", S.ascii_host(F.concat("word", F.lit(".example"))).alias("host"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'hostpath:boards.x.io/acme' || page_id WHEN 1 THEN 'hostpath:x.com/co' || page_id WHEN 2 THEN 'host:' || page_id || '.x.org' END AS tenant FROM pages""")
def fn_45_tenant_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-45: what names a tenant in URLs of each family."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    family = F.when(k == 0, "greenhouse").when(k == 1, "join_com").when(k == 2, "other").otherwise("lever")
    url = F.when(k == 0, F.concat(F.lit("https://Boards.x.io/Acme"), i, F.lit("/jobs/1"))).when(k == 1, F.concat(F.lit("https://x.com/en/companies/CO"), i, F.lit("?a=1"))).when(k == 2, F.concat(F.lit("http://"), i, F.lit(".X.org/a/b"))).otherwise("https://jobs.x.co/")
    return table(spark, sf_dir, "pages").select("page_id", S.tenant_key(family, url).alias("tenant"))


@query(r"""SELECT doc_id, CASE WHEN k = '' OR length(k) > 500 THEN NULL ELSE k END AS identity FROM (SELECT doc_id, lower(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS k FROM documents)""")
def fn_46_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-46: normal form for comparing names; here of whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", S.identity(F.col("text")).alias("identity"))


@query(r"SELECT page_id, 'https://' || split_part(url, '//', 2) AS url FROM (SELECT page_id, regexp_replace(regexp_replace(url, 'utm_[^&#]*&?', '', 'g'), '[?&](#|$)', '\1') AS url FROM pages)")
def fn_47_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-47: tracking parameters out of page URLs, others kept."""
    https = F.concat(F.lit("https://"), F.split_part("url", F.lit("//"), F.lit(2)))
    return table(spark, sf_dir, "pages").select("page_id", S.without_utm(https).alias("url"))


@query("SELECT p_partkey, 'cafe-' || replace(lower(p_name), ' ', '-') || '-and-' || replace(lower(p_brand), '#', '-') || '-plus' AS slug FROM part")
def fn_48_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-48: slugs of names with accents, signs and runs of blanks."""
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat(F.lit("  Café  "), "p_name", F.lit(" & "), "p_brand", F.lit("+!"))).alias("slug"))


@query("SELECT doc_id, sha256(text) AS full_hash FROM documents")
def fn_49_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-49: the content hash as a number, checked against its hexadecimal form."""
    same = F.lpad(F.lower(F.hex(S.content_hash(F.col("text")))), 16, "0") == F.substring(F.sha2("text", 256), 1, 16)
    full = F.when(F.coalesce(same, F.lit(True)), F.sha2("text", 256)).otherwise(F.raise_error(F.lit("content hash differs")).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", full.alias("full_hash"))


@query("SELECT p_partkey, TRUE AS alike, p_size % 2 = 0 AS changed FROM part")
def fn_50_payload_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-50: payloads with keys and list members in another order, or another volatile date, hash alike; other values do not."""
    a = F.concat(F.lit('{"title":"'), "p_name", F.lit('","tags":["x","'), "p_type", F.lit('"],"valid_through":"2024-01-01"}'))
    b = F.concat(F.lit('{"valid_through":"2025-01-01","tags":["'), "p_type", F.lit('","x"],"title":"'), "p_name", F.lit('"}'))
    c = F.when(F.col("p_size") % 2 == 0, F.replace(a, F.lit('"title":"'), F.lit('"title":"new '))).otherwise(a)
    h = lambda x: S.payload_hash(F.col("p_brand"), x)
    return table(spark, sf_dir, "part").select("p_partkey", (h(a) == h(b)).alias("alike"), (h(a) != h(c)).alias("changed"))


@query("""SELECT p_partkey, sha256('{"name":"' || p_name || '","size":' || p_size || ',"words":' || to_json(list_sort(string_split(p_name, ' '))) || ',"kind":' || CASE WHEN p_type = 'SMALL' THEN 'null' ELSE '"' || p_type || '"' END || '}') AS fingerprint FROM part""")
def fn_51_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-51: fingerprints of records whose arrays count in any order."""
    words = F.reverse(F.split("p_name", " "))
    fields = {"name": F.col("p_name"), "size": F.col("p_size"), "words": words, "kind": F.when(F.col("p_type") != "SMALL", F.col("p_type"))}
    return table(spark, sf_dir, "part").select("p_partkey", S.fingerprint(fields, ("words",)).alias("fingerprint"))


@query("""SELECT doc_id, sha256(text) AS full_hash, sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(lang, ''), text)) AS joined, left(sha256(doc_id::VARCHAR), 2) AS bucket FROM documents""")
def fn_49_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-49, FN-52, FN-53: content hash, joined hash and bucket of each document in one pass."""
    h = S.content_hash(F.col("text"))
    same = F.lpad(F.lower(F.hex(h)), 16, "0") == F.substring(F.sha2("text", 256), 1, 16)
    full = F.when(same, F.sha2("text", 256)).otherwise(F.raise_error(F.lit("content hash differs")).cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", full.alias("full_hash"), S.joined_hash(F.col("source"), F.col("lang"), F.col("text")).alias("joined"), S.bucket256(F.sha2(F.col("doc_id").cast("string"), 256)).alias("bucket"))


@query("SELECT doc_id, sha256(concat_ws(chr(31), coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))) AS joined FROM documents")
def fn_52_joined_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-52: a hash of several parts that cannot run into each other; null counts as empty."""
    return table(spark, sf_dir, "documents").select("doc_id", S.joined_hash(F.col("source"), F.col("lang"), F.col("text")).alias("joined"))


@query("SELECT bucket, count(*) AS n FROM (SELECT left(sha256(c_custkey::VARCHAR), 2) AS bucket FROM customer) GROUP BY 1")
def fn_53_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-53: one of 256 buckets from the first digits of an id."""
    raw = F.sha2(F.col("c_custkey").cast("string"), 256)
    uuid = F.concat_ws("-", F.substring(raw, 1, 8), F.substring(raw, 9, 4), F.substring(raw, 13, 20))
    return table(spark, sf_dir, "customer").groupBy(S.bucket256(uuid).alias("bucket")).agg(F.count("*").alias("n"))


# --- embedded data ---------------------------------------------------------------------


@query("""SELECT n_nationkey::VARCHAR AS slug, locale, name, is_alias FROM (SELECT n_nationkey, 'en' AS locale, n_name AS name, FALSE AS is_alias FROM nation UNION ALL SELECT n_nationkey, 'de', 'D ' || n_name, FALSE FROM nation WHERE n_nationkey % 2 = 0
 UNION ALL SELECT n_nationkey, 'any', unnest(['a' || n_nationkey, 'b']), TRUE FROM nation WHERE n_nationkey % 3 = 0)""")
def src_03_wide_locales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-03: a registry with one column a locale and a list of aliases, made long."""
    n = F.col("n_nationkey")
    wide = table(spark, sf_dir, "nation").select(n.cast("string").alias("slug"), F.col("n_name").alias("en"), F.when(n % 2 == 0, F.concat(F.lit("D "), "n_name")).alias("de"), F.when(n % 3 == 0, F.concat(F.lit("a"), n.cast("string"), F.lit("|b"))).otherwise("").alias("aliases"))
    return readers.wide_to_long(wide, "slug", ["en", "de"], "aliases")


@query("SELECT page_id, replace(url, '&', '&amp;') AS raw, url AS loc FROM pages".replace("replace(url, '&', '&amp;') AS raw, ", ""))
def src_08_sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-08: locations of sitemaps, with or without a name space."""
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    xml = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<urlset><url><loc> "), url, F.lit("\n</loc></url></urlset>"))).otherwise(F.concat(F.lit('<s:urlset xmlns:s="x"><s:url><s:loc>'), url, F.lit("</s:loc></s:url></s:urlset>")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(readers.sitemap_locations(xml)).alias("loc"))


@query("SELECT page_id % 7 AS feed, 'T & ' || page_id AS title, url AS link FROM pages")
def src_09_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: items of RSS feeds and entries of Atom feeds, several to a feed."""
    i = F.col("page_id").cast("string")
    item = F.when(F.col("page_id") % 7 < 4, F.concat(F.lit("<item><title><![CDATA[T & "), i, F.lit("]]></title><link>"), F.col("url"), F.lit("</link></item>"))).otherwise(F.concat(F.lit("<entry><title><![CDATA[T & "), i, F.lit(']]></title><link rel="x" href="'), F.col("url"), F.lit('"/></entry>')))
    feeds = table(spark, sf_dir, "pages").select((F.col("page_id") % 7).alias("feed"), item.alias("item")).groupBy("feed").agg(F.concat_ws("\n", F.collect_list("item")).alias("xml"))
    return feeds.select("feed", F.inline(readers.feed_items(F.col("xml"))))


@query("SELECT n_nationkey AS sheet, chr((65 + n_nationkey)::INTEGER) || 'AA' AS currency, round((1.0 / (n_nationkey + 1.25))::DECIMAL(20,12), 12)::DOUBLE AS to_eur FROM nation")
def src_10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-10: reference rates of rate sheets, inverted and kept to 12 places."""
    n = F.col("n_nationkey")
    xml = F.concat(F.lit("<Cube><Cube currency='"), F.char(n + 65), F.lit("AA' rate='"), (n + 1.25).cast("decimal(10,2)").cast("string"), F.lit("'/></Cube>"))
    rates = table(spark, sf_dir, "nation").select(n.alias("sheet"), F.inline(readers.euro_rates(xml)))
    return rates.select("sheet", "currency", F.col("to_eur").cast("double").alias("to_eur"))


@query("""SELECT page_id, 'Job ' || page_id AS title, CASE WHEN page_id % 4 = 1 THEN 'Bistro' ELSE 'Acme' END AS company, CASE WHEN page_id % 4 = 0 THEN 'FULL_TIME' END AS employment_type, CASE WHEN page_id % 4 = 0 THEN '2024-03-01' END AS date_posted,
 CASE WHEN page_id % 4 = 0 THEN 'EUR' ELSE 'CHF' END AS currency, CASE WHEN page_id % 4 = 0 THEN (page_id + 50000)::VARCHAR ELSE '28' END AS "least", CASE WHEN page_id % 4 = 0 THEN (page_id + 60000)::VARCHAR ELSE '28' END AS "most", CASE WHEN page_id % 4 = 0 THEN 'YEAR' ELSE 'HOUR' END AS unit FROM pages WHERE page_id % 4 < 2""")
def src_11_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-11: structured postings inside pages: plain, in a graph behind CDATA, another type, none."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 4
    script = F.lit('<script type="application/ld+json">')
    plain = F.concat(F.lit('{"@type":"JobPosting","title":"Job '), i, F.lit('","hiringOrganization":{"name":"Acme"},"employmentType":["PART_TIME","FULL_TIME"],"datePosted":"2024-03-01","baseSalary":{"currency":"EUR","value":{"minValue":'), (F.col("page_id") + 50_000).cast("string"), F.lit(',"maxValue":'), (F.col("page_id") + 60_000).cast("string"), F.lit(',"unitText":"YEAR"}}}'))
    graph = F.concat(F.lit('<![CDATA[{"@graph":[{"@type":"WebPage"},{"@type":"JobPosting","title":"Job '), i, F.lit('","hiringOrganization":"Bistro","baseSalary":{"currency":"CHF","unitText":"HOUR","value":28}}]}]]>'))
    body = F.when(k == 0, plain).when(k == 1, graph).when(k == 2, '{"@type":"Article","title":"No JobPosting"}')
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.coalesce(F.concat(script, body, F.lit("</script>")), F.lit(""))).alias("html"))
    return readers.json_ld_postings(pages, "page_id", "html")


@query("""SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{"a": "}{", "b": [1, ' || page_id || ']}' ELSE '[' || page_id || ', {"x": null}]' END AS payload FROM pages WHERE page_id % 3 < 2""")
def src_12_embedded_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-12: JSON behind a script marker in pages; a broken value gives none."""
    i, k = F.col("page_id").cast("string"), F.col("page_id") % 3
    body = F.when(k == 0, F.concat(F.lit('{"b":[1,'), i, F.lit('],"a":"}{"}; go()'))).when(k == 1, F.concat(F.lit("\n["), i, F.lit(',{"x":null}]'))).otherwise("{broken")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.lit("<script>window.state = "), body, F.lit("</script>")).alias("html"))
    return readers.embedded_json(pages, "page_id", "html", "window.state =")
