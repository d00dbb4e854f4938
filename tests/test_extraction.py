"""Dictionary terms, languages and HTML forms against plain versions and exact cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaylark import catalogue
from quaylark.functions import dictionary, htmltree, languages

TERMS = [
    ("cpp", "C++", False), ("csharp", "C#", False), ("dotnet", ".NET", False), ("java", "Java", True), ("javascript", "JavaScript", False), ("js", "JS", True), ("go", "Go", True), ("go", "golang", False), ("r", "R", True),
    ("spark", "Apache Spark", False), ("sql", "SQL", False), ("tsql", "T-SQL", False), ("node", "Node.js", False), ("i", "Éa", False), ("ss", "straße", False), ("a", "aa", False), ("a2", "aaa", True), ("a3", "AAA", False), ("empty", "", False),
]


def by_regex(text: str) -> list[str]:
    """One pattern a term."""
    text = re.sub(r"<[^>]+>", " ", text) if "<" in text else text
    hits = {s for s, t, c in TERMS if t and re.search(rf"(?<!\w){re.escape(t)}(?!\w)", text, 0 if c else re.I)}
    return sorted(hits)


def test_terms_equal_one_pattern_each(spark):
    rng = random.Random(1)
    bits = [t for _, t, _ in TERMS] + [t.lower() for _, t, _ in TERMS] + [" ", ", ", ".", "+", "#", "x", "_", "<b>", "é", "(", ")", "20", "ß", "AAAA"]
    texts = ["C++20 and C++, .NET/C#", "JavaScript is not Java", "we go, Go!", "<b>T-SQL</b>on<i>Node.js</i>", "", None] + ["".join(rng.choice(bits) + rng.choice([" ", ""]) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, slug string")
    terms = spark.createDataFrame(TERMS, "slug string, term string, capitals boolean")
    for block in (1000, 5):  # one automaton, and several
        got = {r["id"]: r["terms"] for r in dictionary.with_terms(df, "text", terms, block).collect()}
        assert got == {i: by_regex(t or "") for i, t in enumerate(texts)}


def test_thousands_of_terms(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    words = sorted({w for r in docs.collect() for w in re.findall(r"\w{4,}", (r["text"] or "").lower())})
    assert len(words) > 2000
    terms = spark.createDataFrame([(w, w, False) for w in words[::2]] + [(f"{w} {v}", f"{w} {v}", False) for w, v in zip(words, words[1:])], "slug string, term string, capitals boolean")
    wanted = set(words[::2])
    for r in dictionary.with_terms(docs, "text", terms).limit(60).collect():
        text = re.sub(r"<[^>]+>", " ", r["text"] or "")
        assert {t for t in r["terms"] if " " not in t} == wanted & set(re.findall(r"\w+", dictionary.lowered(text)))


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return languages.learn(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2), "text", "lang")


def test_held_out_accuracy(spark, sf_dir):
    rows = catalogue.queries()["fn_07_language"](spark, sf_dir).where("lang IS NOT NULL").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    right = sum(r["lang"] == r["found"] for r in held) / len(held)
    assert len(held) > 20 and right >= 0.95, right


def test_learning_counts_what_a_loop_counts(spark, sf_dir, model):
    names, table = model
    docs = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    counts = {n: Counter() for n in names}
    for r in docs:
        counts[r["lang"]].update(languages.trigrams(r["text"] or "")[0].tolist())
    for j, n in enumerate(names):
        total = sum(counts[n].values()) + 0.5 * languages.CELLS
        for cell in (0, 7, 4711, max(counts[n], key=counts[n].get)):
            assert table[cell, j] == pytest.approx(np.log((counts[n][cell] + 0.5) / total), abs=1e-4)


def test_shares_of_mixed_texts(spark, sf_dir, model):
    own = {r["lang"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL AND length(text) > 3000").collect()}
    a, b = sorted(own)[:2]
    texts = [own[a][:3000], own[a][:2000] + own[b][:1000], own[a][:2900] + own[b][:100], "12 34", "", None, own[b][:60]]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id int, text string, lang string")
    got = {r["id"]: (r["language"], r["languages"]) for r in languages.with_languages(df, "text", model).collect()}
    assert got[0] == (a, [a]) and got[1] == (a, [a, b]) and got[2][1] == [a]
    assert got[3] == got[4] == got[5] == (None, [])
    assert got[6] == (b, [b])  # shorter than the least chunk: one chunk
    nothing = languages.learn(df.where("id > 99"), "text", "lang")
    assert languages.with_languages(df, "text", nothing).where("language IS NOT NULL").count() == 0


CLEAN = [
    ("<p>one<p>two", "<p>one</p><p>two</p>"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>"),
    ("<div class=x>a <b style='y'>b</b> <span>c</span></div>", "a <b>b</b> c"),
    ("<table><tr><td>1<td>2<tr><td><p>3</table>after", "12<p>3</p>after"),
    ("<script>var t='</p>'</script><style>p{}</style><p onclick=e>x<svg><p>in</p></svg></p>", "<p>x</p>"),
    ("a<br>b<br/>c</br>d<hr>", "a<br>b<br>c<br>d<hr>"),
    ("</div>x</p>", "x"),
    ("&lt;p&gt;hi &amp;amp; bye&lt;/p&gt;", "<p>hi &amp; bye</p>"),
    ("1 &lt; 2&nbsp;&amp; 3", "1 &lt; 2 &amp; 3"),
    ("<h1>T</h1><a href='u'>l</a>", "<h1>T</h1><a>l</a>"),
    ("<b><i>x</b>y</i>", "<b><i>x</i></b>y"),
    ("  ", None), ("", None), (None, None), ("<script>x</script>", None),
]


@pytest.mark.parametrize("raw,want", CLEAN)
def test_clean(raw, want):
    assert htmltree.clean(raw) == want


LABELLED = [
    ("<h1>T</h1><h6>S</h6><b>x</b> y", "<h2>T</h2>\n<h4>S</h4>\n<p><strong>x</strong> y</p>", "T\n\nS\n\nx\n y"),
    ("first line\nsecond line", "<p>first line</p>\n<p>second line</p>", "first line\n\nsecond line"),
    ("a b\nc\n\nd", "<p>a b\nc</p>\n<p>d</p>", "a b\nc\n\nd"),
    ("<div>naked<p></p><ul></ul><a href='u' class=c>l</a><p>x</p></div>", '<p>naked<a href="u">l</a></p>\n<p>x</p>', None),
    ("<ol><li>1<li>2</ol>", "<ol><li>1</li>\n<li>2</li>\n</ol>", None),
    ("", "", ""), (None, "", ""), ("   ", "", ""),
]


@pytest.mark.parametrize("raw,html,text", LABELLED)
def test_labelled(raw, html, text):
    got = htmltree.labelled(raw)
    assert got[0] == html
    if text is not None:
        assert re.sub(r"\s+", " ", got[1]) == re.sub(r"\s+", " ", text)


def test_any_input_keeps_its_text():
    rng = random.Random(7)
    tags = "p div li ul ol td tr table b i h1 span br section dl dt dd a th tbody".split()
    for _ in range(500):
        words, parts = [], []
        for k in range(rng.randint(0, 25)):
            kind = rng.random()
            if kind < 0.4:
                words.append(f"w{k}")
                parts.append(f" w{k} ")
            else:
                parts.append(f"<{'/' if kind > 0.7 else ''}{rng.choice(tags)}>")
        page = "".join(parts)
        form, text = htmltree.labelled(page)
        assert re.findall(r"w\d+", text) == words == re.findall(r"w\d+", htmltree.clean(page) or "")
        assert form.count("<ul>") == form.count("</ul>") and form.count("<p>") == form.count("</p>")


def test_broken_pages_lose_nothing(spark):
    pages = ["<", "<p", "x<![if !y]>z", "a</", "<!--c", "<a href='", "&#xZZ;", "<p>ok", "<div>" * 5000 + "deep", None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "id int, html string")
    got = {r["id"]: r for r in htmltree.normalised(df, "id", "html").collect()}
    assert len(got) == len(pages)
    assert got[7]["clean"] == "<p>ok</p>" and got[8]["clean"] == "deep" and "z" in got[2]["text"]
    assert got[9]["clean"] is None and got[9]["labelled"] is None and got[10]["coverage"] == 1.0
    assert htmltree.normalised(df.limit(0), "id", "html").count() == 0


def test_pages_are_covered(spark, sf_dir):
    rows = catalogue.queries()["fn_04_labelled_html"](spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    assert all(r["coverage"] >= 0.7 and not r["broken"] for r in rows)
