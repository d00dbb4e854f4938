"""Functions that read whole pages or texts in Python hold a megabyte of them at a time, not all of an Arrow batch."""

import numpy as np
import pyarrow as pa
import pytest

from quaylark.functions import extract, htmltree, languages
from quaylark.plans import texts
from quaylark.sources import readers

PAGE = "<h1>T</h1><p>" + "some words of a page. " * 450 + "</p>"  # 10 kB


@pytest.fixture
def given_back(spark, monkeypatch):
    """Makes of (function of a frame, texts): rows of each batch that the task gives back for one batch of all texts."""

    def of(make, texts):
        df = spark.createDataFrame([(0, "")], "id long, html string")
        tasks = []
        asked = type(df).mapInArrow
        monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, *a, **b: tasks.append((self.columns, run)) or asked(self, run, *a, **b))
        make(df)
        (names, run), = tasks
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names)
        return [b.num_rows for b in run(iter([batch]))]

    return of


def test_normal_forms_by_the_megabyte(given_back):
    sizes = given_back(lambda df: htmltree.normalised(df, "id", "html"), [PAGE, None, ""] * 300)
    assert sum(sizes) == 900 and len(sizes) >= 3 and max(sizes) <= 400


def test_cleaned_pages_by_the_megabyte(given_back, monkeypatch):
    """``fn_03_clean_html``: bounded batches, one parse a page, no other form."""
    parsed, parse = [], htmltree.parse
    monkeypatch.setattr(htmltree, "parse", lambda page: parsed.append(page) or parse(page))
    monkeypatch.setattr(texts, "table", lambda spark, sf_dir, name: spark)
    sizes = given_back(lambda df: texts.fn_03_clean_html(df.withColumnRenamed("id", "page_id"), ""), [PAGE, None, ""] * 300)
    assert sum(sizes) == 900 and len(sizes) >= 3 and max(sizes) <= 400
    assert len(parsed) == 900


def test_cleaned_pages_are_the_clean_form(spark):
    pages = [PAGE, None, "", " ", "<p>a<script>b</script>", "&lt;p&gt;x &amp; y&lt;/p&gt;", "<![bad<p>z", PAGE]
    df = spark.createDataFrame([*enumerate(pages), (0, "<h7>again</h7>")], "id long, html string")
    got, want = htmltree.cleaned(df, "id", "html"), htmltree.normalised(df, "id", "html").select("id", "clean")
    assert got.schema == want.schema
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_blocks_by_the_megabyte(given_back):
    sizes = given_back(lambda df: extract.blocks(df, "id", "html"), [PAGE, None, ""] * 300)
    assert sum(sizes) == 600 and len(sizes) >= 3 and max(sizes) <= 300


def test_embedded_json_by_the_megabyte(given_back):
    sizes = given_back(lambda df: readers.embedded_json(df, "id", "html", "x ="), [PAGE + "x = [1]", PAGE, None] * 300)
    assert sum(sizes) == 300 and len(sizes) >= 3 and max(sizes) <= 150


def test_languages_by_the_megabyte(given_back):
    model = ["a", "b"], np.zeros((languages.CELLS, 2), np.float32)
    sizes = given_back(lambda df: languages.with_languages(df, "html", model), [PAGE, None, ""] * 300)
    assert sum(sizes) == 900 and len(sizes) >= 3 and max(sizes) <= 400
