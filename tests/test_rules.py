"""Golden cases of the extraction rules, and plain versions of those that fold."""

import datetime

import pytest
from pyspark.sql import functions as F

from quaylark import catalogue
from quaylark.functions import experience, places, salary, scalars, spans
from quaylark.operators import hierarchy, ingest
from quaylark.sources import readers

PAY = [
    ("USA, WA, Redmond - 137,300.00 - 185,700.00 USD annually", [(137300, 185700, "USD", "year")]),
    ("90,000 - 120,000 USD per year", [(90000, 120000, "USD", "year")]),
    ("50000 - 70000 (yr)", [(50000, 70000, "USD", "year")]),
    ("salary $105,000-$149,000 + bonus", [(105000, 149000, "USD", "year")]),
    ("We raised $50,000,000 - $60,000,000 in funding, salary", []),
    ("A$120,000 - A$150,000 salary", [(120000, 150000, "AUD", "year")]),
    ("pay is $25 per hour", [(2500, 2500, "USD", "hour")]),
    ("$120K AUD per year", [(120000, 120000, "AUD", "year")]),
    ("salary S$5,000 monthly", [(5000, 5000, "SGD", "month")]),
    ("Gehalt 55.000 € bis 65.000 € pro Jahr", [(55000, 65000, "EUR", "year")]),
    ("2.500 € netto Gehalt", []),
    ("commuting allowance 500 € salary monthly", []),
    ("hourly rate: £12.50", [(1250, 1250, "GBP", "hour")]),
    ("CHF 90'000.– Lohn", [(90000, 90000, "CHF", "year")]),
    ("wynagrodzenie 10 000 - 15 000 zł miesięcznie", [(10000, 15000, "PLN", "month")]),
    ("fizetés 600 000 - 800 000 Ft havi", [(600000, 800000, "HUF", "month")]),
    ("salariu 5000 lei pe lună", [(5000, 5000, "RON", "month")]),
    ("заплата 3000 лв месечно", [(3000, 3000, "BGN", "month")]),
    ("løn 45.000 DKK pr. måned", [(45000, 45000, "DKK", "month")]),
    ("SEK 134 billion revenue salary", []),
    ("85 - 95K EUR salary", [(85000, 95000, "EUR", "year")]),
    ("salary $60,000 - $70,000; again $60,000 - $70,000", [(60000, 70000, "USD", "year")]),
    ("Salary: $90,000 - $120,000 per year", [(90000, 120000, "USD", "year")]),
    ("Gehalt: 4.500 € monatlich", [(4500, 4500, "EUR", "month")]),
    ("pay £25 per hour", [(2500, 2500, "GBP", "hour")]),
    ("annual salary 85K - 95K EUR", [(85000, 95000, "EUR", "year")]),
    ("We raised $50,000,000 of funding", []),
    ("Tickets cost $15", []),
    ("salary 5 - 3 EUR per hour", []),
    ("no numbers", []),
    ("", []),
    (None, []),
]


def test_pay(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(PAY)], "id int, text string, offers_note string")
    got = {r["id"]: [tuple(o) for o in r["offers"] or []] for r in salary.with_pay(df, "text").collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAY)}


def test_usual_offer(spark):
    df = spark.createDataFrame([(1, "pay €50.000 - €60.000 pro Jahr, salary $70,000 - $80,000 or $75,000 - $90,000"), (2, "none")], "id int, text string")
    got = {r["id"]: r["o"] for r in salary.with_pay(df, "text").select("id", salary.usual("offers").alias("o")).collect()}
    assert tuple(got[1]) == (70000, 90000, "USD", "year") and got[2] is None


YEARS = [
    ("5+ years of experience", (5, None)), ("at least 2 years; 6 years of experience", (6, None)), ("founded 20 years ago with 20 years experience", None), ("at least 3 years", (3, None)), ("2-4 years", (2, 4)), ("mindestens 7 Jahre", (7, None)), ("for over 40 years", None),
    ("founded 20 years ago, we ask 6 years of experience", None), ("at least 2 years; later, after a while and by other means than those named so far, 6 years of experience", (6, None)), ("4 to 2 years", None), ("3 - 5 years and 3 years experience", (3, 5)), ("", None), (None, None),
    ("18 months of experience", (1.5, None)), ("8 months experience supporting customers", (0.7, None)), ("1.5 years of experience", (1.5, None)), ("Minimum 2,5 years of work", (2.5, None)), ("5 anni di esperienza", (5, None)), ("minimum 5 jaar ervaring", (5, None)), ("5 års erfaring", None), ("5 år erfaring", (5, None)),
    ("6-18 months of professional experience", (0.5, 1.5)), ("Minimum 6 months to 1 year work experience", (0.5, 1)), ("Erfahrung von mindestens 5 Jahren", (5, None)), ("esperienza di almeno 4 anni nel settore", (4, None)), ("expérience de 3 ans minimum", (3, None)), ("Berufserfahrung von 7+ Jahren", (7, None)),
]


def test_years(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(YEARS)], "id int, text string")
    got = {r["id"]: r["experience"] and tuple(r["experience"]) for r in experience.with_experience(df, "text").collect()}
    assert got == {i: want for i, (_, want) in enumerate(YEARS)}


def test_matches_give_places_and_groups(spark):
    texts = ["a1 bb22", "22", "", None, "x", "1a1", "😀7"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: [(m["start"], m["end"], m["n"]) for m in r["m"] or []] for r in df.select("id", spans.matches(F.col("text"), r"[a-z]?(?P<n>\d+)").alias("m")).collect()}
    assert got == {0: [(0, 2, "1"), (4, 7, "22")], 1: [(0, 2, "22")], 2: [], 3: [], 4: [], 5: [(0, 1, "1"), (1, 3, "1")], 6: [(1, 2, "7")]}


def plain_chunks(text: str, size: int) -> list[str]:
    out, start = [], 0
    while start < len(text):
        if start + size >= len(text):
            return [*out, text[start:]]
        blank = text.rfind(" ", start, start + size)
        stop = blank if blank > start else start + size
        out.append(text[start:stop])
        start = stop + 1
    return out


def test_chunks_against_a_loop(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab  \n😀") for _ in range(n)) for n in range(1, 90)] + ["x" * n for n in range(1, 40)] + [" " * n for n in range(1, 30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["c"] for r in df.select("id", scalars.chunks(F.col("text"), 10).alias("c")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == plain_chunks(text, 10), repr(text)


@pytest.fixture(scope="module")
def gazetteer(spark):
    entries = [(1, None, "country", 80), (2, None, "country", 330), (3, None, "country", 5), (10, 1, "city", 4), (11, 1, "city", 2), (12, 2, "city", 1), (13, 3, "city", 1), (14, 2, "region", 10), (15, 14, "city", 6), (16, 2, "region", 200), (17, 16, "city", 3), (18, None, "macro", 700), (19, 1, "city", 2)]
    names = [("Germany", 1), ("USA", 2), ("Ireland", 3), ("Berlin", 10), ("Hamburg", 11), ("Berlin", 12), ("Dublin", 13), ("Geneva", 14), ("Geneva", 15), ("Montana", 16), ("Montana", 17), ("Europe", 18), ("Zürich City", 19), ("The Hague", 13)]
    codes = [("DE", "Germany"), ("DEU", "Germany"), ("US", "USA"), ("IE", "Ireland")]
    return (
        spark.createDataFrame([(n, i, "en") for n, i in names], "name string, id long, locale string"),
        spark.createDataFrame(entries, "id long, parent_id long, kind string, population long"),
        spark.createDataFrame(codes, "code string, name string"),
    )


PLACES = {
    "Hamburg, Germany": {11}, "Berlin, USA": {12}, "Berlin": {10}, "germany": {1}, "Nowhere": {None}, "Dublin, Berlin, Hamburg": {13, 10, 11}, "Hamburg; Dublin ; hamburg": {11, 13}, "DE": {1}, "DEU": {1}, "US-Berlin": {12}, "Berlin, IE": {10, 3},
    "Geneva": {15}, "Montana": {16}, "zurich": {19}, "Zürich City": {19}, "Hague": {13}, "Berlin, Mitte, Germany": {10}, "Hamburg / Germany": {11}, " ": set(), "": set(),
}


def test_places(spark, gazetteer):
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(PLACES)] + [(99, None)], "k int, raw string")
    got: dict = {i: set() for i in range(len(PLACES))} | {99: set()}
    for r in places.resolve(raw, "k", "raw", *gazetteer).collect():
        got[r["k"]].add(r["id"])
    assert got == {i: want for i, want in enumerate(PLACES.values())} | {99: set()}


def test_closure_of_cycles_and_wide_trees(spark):
    cycle = spark.createDataFrame([(1, 2), (2, 1), (3, None)], "id long, parent_id long")
    got = hierarchy.closure(cycle, 4).collect()
    assert max(r["depth"] for r in got) == 4 and sum(r["id"] == 3 for r in got) == 1
    wide = spark.range(600_000).select("id", F.when(F.col("id") > 0, F.floor(F.col("id") / 1000)).alias("parent_id"))
    assert hierarchy.closure(wide).count() == 600_000 + 599_999 + 599_000  # beyond the limit of recursive expressions


def test_buckets_fill_in_order(spark):
    rows = [("s", v, n) for v, n in (("a", 900), ("b", 900), ("c", 500), ("d", None), ("e", 10), ("f", 10))] + [("t", "x", 5000)]
    df = spark.createDataFrame(rows, "source string, value string, n long").withColumn("cap", F.lit(2000))
    got = {(r["source"], r["value"]): r["bucket"] for r in readers.filled_buckets(df, "source", "value", "n", "cap").collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 1, ("s", "c"): 2, ("s", "d"): 3, ("s", "e"): 4, ("s", "f"): 4, ("t", "x"): 1}


HOSTS = {
    "München.de": "xn--mnchen-3ya.de",
    "bücher.example.": "xn--bcher-kva.example",
    "straße.de": "strasse.de",
    "例え.テスト": "xn--r8jz45g.xn--zckzah",
    "例え。テスト": "xn--r8jz45g.xn--zckzah",
    "ÅNGSTRÖM.se": "xn--ngstrm-hua5l.se",
    "пример.испытание": "xn--e1afmkfd.xn--80akhbyknj4f",
    "A.B-c.ORG": "a.b-c.org",
    "a" * 63 + ".org": "a" * 63 + ".org",
    "a" * 64 + ".org": None,
    "ü" * 70 + ".org": None,
    "a..org": None,
    "ü..org": None,
    "": None,
    None: None,
}


def plain_punycode(label: str) -> str:
    """RFC 3492 by its own words: code points from the least on, each as a run of generalised integers."""
    out, n, delta, bias = [c for c in label if ord(c) < 128], 128, 0, 72
    basic = done = len(out)
    digits = "abcdefghijklmnopqrstuvwxyz0123456789"
    if basic:
        out.append("-")
    while done < len(label):
        m = min(ord(c) for c in label if ord(c) >= n)
        delta, n = delta + (m - n) * (done + 1), m
        for c in label:
            delta += ord(c) < n
            if ord(c) == n:
                q, k = delta, 36
                while q >= (t := min(max(k - bias, 1), 26)):
                    out.append(digits[t + (q - t) % (36 - t)])
                    q, k = (q - t) // (36 - t), k + 36
                out.append(digits[q])
                delta = delta // 700 if done == basic else delta // 2
                delta += delta // (done + 1)
                k = 0
                while delta > 455:
                    delta, k = delta // 35, k + 36
                bias, delta, done = k + 36 * delta // (delta + 38), 0, done + 1
        delta, n = delta + 1, n + 1
    return "".join(out)


def test_hosts_beyond_ascii(spark, sf_dir):
    df = spark.createDataFrame(list(HOSTS.items()), "raw string, want string").repartition(3)
    assert [tuple(r) for r in df.withColumn("got", scalars.ascii_host(F.col("raw"))).where("NOT (got <=> want)").collect()] == []
    url = spark.createDataFrame([("https://Bücher.example:443/Stellen/?utm_a=1",)], "u string").select(scalars.board_url(F.col("u")).alias("u"))
    assert url.first()["u"] == "https://xn--bcher-kva.example/Stellen"
    beyond = [r for r in catalogue.queries()["fn_44_word_hosts"](spark, sf_dir).collect() if not r["word"].isascii()]
    assert len(beyond) > 5
    for r in beyond:
        assert "ß" in r["word"] or r["host"] == f"xn--{plain_punycode(r['word'].lower())}.example"


def test_urls(spark):
    rows = [("HTTP://Jobs.Example.COM.:80/a/?b=2&a=1&utm_x=1#t", "https://jobs.example.com/a?a=1&b=2"), ("https://x.org", "https://x.org/"), ("https://u:p@x.org/", None), ("ftp://x.org/", None), ("", None), (None, None), ("https://x.org:8443//", "https://x.org:8443/")]
    df = spark.createDataFrame(rows, "raw string, want string")
    assert [(r["raw"], r["want"]) for r in df.select("raw", "want", scalars.board_url(F.col("raw")).alias("got")).where("NOT (got <=> want)").collect()] == []
    same = "https://other.org/xf-0a/opp?_s.crb=1"
    r = spark.createDataFrame([(same,)], "u string").select(scalars.without_session(F.col("u")).alias("a"), scalars.tenant_key(F.lit("lever"), F.lit("https://j.co/")).alias("b")).first()
    assert (r["a"], r["b"]) == (same, None)


def test_payload_hash_of_odd_payloads(spark):
    rows = [('{"a":1,"b":["y","x"]}', '{"b":["x","y"],"a":1}', True), ('{"a":1}', '{"a":2}', False), ("not json", "not json", True), (None, None, True), ('{"valid_through":"1"}', "{}", True)]
    df = spark.createDataFrame(rows, "x string, y string, want boolean")
    h = lambda c: scalars.payload_hash(F.lit("d"), F.col(c))
    assert df.where((h("x") == h("y")) != F.col("want")).count() == 0


def plain_blocks(page: str) -> list[tuple[str, str]]:
    """Blocks by a tag scanner: text between block tags, with what must not be shown cut out before."""
    import html
    import re

    block = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "div", "article", "section"}
    shown = {"h1": "h2", "h5": "h4", "h6": "h4", "div": "p", "article": "p", "section": "p", "td": "p", "th": "p", "pre": "p", "blockquote": "p"}
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?is)<(script|style|noscript|nav|header|footer|template|svg)\b.*?</\1\s*>", "<hr>", page)
    out, stack, text = [], ["p"], ""

    def flush():
        nonlocal text
        if text.split():
            out.append((shown.get(stack[-1], stack[-1]), " ".join(html.unescape(text).split())))
        text = ""

    for part in re.split(r"(<[^>]*>)", page):
        tag = re.match(r"<(/?)(\w+)", part)
        if not part.startswith("<"):
            text += part
        elif tag and tag[2].lower() == "br":
            text += " "
        elif tag and tag[2].lower() == "hr":
            flush()
        elif tag and tag[2].lower() in block:
            flush()
            name = tag[2].lower()
            if not tag[1]:
                stack.append(name)
            elif name in stack[1:]:
                while stack.pop() != name:
                    pass
    flush()
    return out


def test_blocks_of_pages_against_a_scanner(spark, sf_dir):
    from quaylark.functions import extract

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got: dict = {}
    for r in extract.blocks(pages, "page_id", "html").orderBy("page_id", "block_id").collect():
        got.setdefault(r["page_id"], []).append((r["tag"], r["text"]))
    for r in pages.collect():
        want = plain_blocks(r["html"])
        assert got.get(r["page_id"], []) == want


def test_repeated_keys_merge_once(spark):
    from quaylark.operators import merge

    target = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 1), (1, None, 0)], "id int, v string, n int")
    got = merge.upsert(target, merge.last_of_each(rows, ["id"], F.col("n")).select("id", "v"), ["id"])
    assert sorted(map(tuple, got.collect())) == [(1, "y"), (2, "b"), (3, "z")]


LEVELS = [
    ("Senior Engineer", "senior"), ("Sr. Engineer", "senior"), ("Seniority", None), ("Senior", None), ("Jr Analyst", "entry"), ("Distinguished Engineer", "principal"), ("Staff Nurse", "staff"), ("Lead Developer", "lead"), ("Lead Generation Manager", None), ("Lead Qualification Specialist", None), ("Tech Lead", "lead"), ("Team Lead, Sales", "lead"),
    ("Head of Product", "director"), ("Overhead Crane Operator", None), ("Director of Sales", "director"), ("Director, Sales", "director"), ("Director", None), ("Art Director", None), ("Funeral Director", None), ("Direktor Vertrieb", "director"), ("VP Engineering", "director"), ("Vice President Sales", "director"), ("VPN Engineer", None),
    ("CEO", "executive"), ("CTO / Founder", "executive"), ("CIO Advisory Manager", None), ("CIO Advisor", None), ("Managing Director Europe", "executive"), ("Geschäftsführer", "executive"), ("Geschäftsführerin (m/w/d)", "executive"),
    ("Working Student Marketing", "intern"), ("Apprentice Electrician", "intern"), ("Ausbildung zum Koch", "intern"), ("Werkstudent:in Frontend", "intern"), ("Stage Marketing", "intern"), ("Google Stage 2", None), ("Internal Auditor", None), ("Duales Studium Informatik", "intern"), ("Graduate Scheme Engineering", "entry"), ("New Grad Engineer", "entry"), ("", None), (None, None),
]


def test_levels(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LEVELS)], "id int, title string")
    got = {r["id"]: r["level"] for r in df.select("id", scalars.seniority(F.col("title")).alias("level")).collect()}
    assert {LEVELS[i][0]: v for i, v in got.items()} == dict(LEVELS)


def test_pay_of_equal_texts_is_read_once(spark):
    """Equal texts cost one text; no side of the join is broadcast, and rows without a text stay."""
    df = spark.range(1000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'salary of $60,000 - $70,000' WHEN id % 3 = 1 THEN 'no pay' END AS text", "1 AS clash")
    got = salary.with_pay(df, "text")
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate(keys=[_text" in plan and "Broadcast" not in plan
    assert got.columns == ["id", "text", "clash", "offers"]
    assert {r["id"]: [tuple(o) for o in r["offers"]] for r in got.collect()} == {i: [(60000, 70000, "USD", "year")] if i % 3 == 0 else [] for i in range(1000)}
