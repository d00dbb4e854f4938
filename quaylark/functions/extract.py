"""Structured attributes from text: occupation and HTML blocks. Pay, experience, places, languages and HTML forms have modules of their own."""

from __future__ import annotations

import html as html_entities
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import rows_of_texts

# --- occupation by a dictionary ------------------------------------------------------


def with_occupation(df: DataFrame, key: str, title: str, aliases: DataFrame, least_bag: int = 4) -> DataFrame:
    """``df`` with the slug of an alias (alias, slug): the whole title, else the longest alias between word
    borders, else the longest of ``least_bag`` words or more whose words all occur in any order.

    Titles and aliases meet on their words: an alias is a candidate where its first word
    occurs, so nothing is compared with everything.
    """
    first = aliases.withColumn("word", F.split("alias", " ")[0])
    words = df.select(key, title, F.explode(F.array_distinct(F.split(F.col(title), " "))).alias("word"))
    parts = F.split("alias", " ")
    inside = F.contains(F.concat(F.lit(" "), F.col(title), F.lit(" ")), F.concat(F.lit(" "), F.col("alias"), F.lit(" ")))
    bag = (F.size(parts) >= least_bag) & (F.size(F.array_except(parts, F.split(F.col(title), " "))) == 0)
    step = F.when(F.col("alias") == F.col(title), 3).when(inside, 2).when(bag, 1)
    hit = words.join(first, "word").withColumn("step", step).where("step IS NOT NULL")
    best = hit.groupBy(key).agg(F.max_by("slug", F.struct("step", F.length("alias"), "slug")).alias("occupation"))
    return df.join(best, key, "left")


# --- HTML blocks --------------------------------------------------------------------

BLOCKS = T.StructType([T.StructField("block_id", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("text", T.StringType())])
_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "blockquote", "pre", "div", "article", "section"}
_SKIP = {"script", "style", "noscript", "nav", "header", "footer", "template", "svg"}
_RENAME = {"h1": "h2", "h5": "h4", "h6": "h4", "div": "p", "article": "p", "section": "p", "td": "p", "th": "p", "pre": "p", "blockquote": "p"}


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, str]] = []
        self.stack, self.skip, self.text = ["p"], 0, []

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            tag = self.stack[-1]
            self.out.append((_RENAME.get(tag, tag), text))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _SKIP:
            self.flush()
            self.skip += 1
        elif tag in _BLOCK:
            self.flush()
            self.stack.append(tag)
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in _BLOCK:
            self.flush()
            if tag in self.stack[1:]:
                while self.stack.pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)


def html_blocks(raw: str | None) -> list[tuple[str, str]] | None:
    """(tag, text) of the blocks of a page; null for null, never an error."""
    if raw is None:
        return None
    if "<" not in raw and "&lt;" in raw:
        raw = html_entities.unescape(raw)
    p = _Blocks()
    try:
        p.feed(raw)
        p.close()
    except (AssertionError, ValueError):
        pass
    p.flush()
    return p.out


def blocks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, block_id, tag, text) of every page."""
    return rows_of_texts(pages, key, html, BLOCKS, lambda page: ((i, tag, text) for i, (tag, text) in enumerate(html_blocks(page) or [])))


def bullets(text: Column) -> Column:
    """Plain text to paragraphs and a list: lines that start with a bullet become items."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda l: F.trim(l)), lambda l: l != "")
    html = F.transform(lines, lambda l: F.when(l.rlike(r"^[-*•]\s"), F.concat(F.lit("<li>"), F.regexp_replace(l, r"^[-*•]\s+", ""), F.lit("</li>"))).otherwise(F.concat(F.lit("<p>"), l, F.lit("</p>"))))
    return F.regexp_replace(F.regexp_replace(F.array_join(html, ""), "(?<!</li>)<li>", "<ul><li>"), "</li>(?!<li>)", "</li></ul>")
