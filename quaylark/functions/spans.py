"""Matches of a pattern with their places and groups, as columns.

Spark has no function that gives offsets of all matches. A replacement that puts marks
around all matches does: a match starts after the pieces and matches before it. Patterns
are written with named groups; the names become the fields of each match. The cost of a text grows with the square of its matches,
which are few in the texts that the extractors let through.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLAGS = "(?iu)"


def groups_of(pattern: str) -> tuple[str, dict[str, int]]:
    """The pattern with plain groups (case does not count), and the number of each named group."""
    return FLAGS + re.sub(r"\(\?P<\w+>", "(", pattern), dict(re.compile(pattern).groupindex)


#: Noncharacters that mark where a match starts and where its parts end, and one that stands for them where a text has them.
_BEGUN, _PARTED, _STAND_IN = "\ufdd0", "\ufdd1", "\ufdd2"


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,(a string for each named group)>>; a group without a match is empty.

    One replacement shows all matches and groups of a text between marks, so a pattern is
    searched twice at most. Where a group holds one of the marks' own characters, it shows U+FDD2.
    """
    java, numbers = groups_of(pattern)
    names = [*numbers]
    shown = _BEGUN + "".join(f"${n}{_PARTED}" for n in (0, *numbers.values()))
    marked = F.regexp_replace(F.translate(text, _BEGUN + _PARTED, _STAND_IN * 2), java, shown)
    pieces = F.transform(F.split(marked, _BEGUN, -1), lambda p: F.split(p, _PARTED, -1))  # what stands before the first match, then each match with what follows it
    kind = f"array<struct<start:int,end:int,{','.join(f'{n}:string' for n in names)}>>"

    def step(acc: Column, m: Column) -> Column:
        end = acc["at"] + F.length(F.get(m, 0))
        row = F.struct(acc["at"].alias("start"), end.alias("end"), *[F.get(m, i).alias(n) for i, n in enumerate(names, 1)])
        return F.struct((end + F.coalesce(F.length(F.get(m, len(names) + 1)), F.lit(0))).alias("at"), F.when(F.size(m) == 1, acc["out"]).otherwise(F.concat(acc["out"], F.array(row))).alias("out"))

    none = F.array().cast(kind)
    return F.when(text.rlike(java), F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])).otherwise(none)


def around(text: Column, m: Column, before: int, after: int) -> Column:
    """A match with up to so many characters before and after it."""
    start = F.greatest(m["start"] - before, F.lit(0))
    return F.substr(text, start + 1, m["end"] + after - start)


def earliest(text: Column, marks: tuple[tuple[str, str], ...]) -> Column:
    """The name whose pattern matches first in a text; of two at one place the one listed first; null without any."""
    at = [F.struct(F.regexp_instr(text, F.lit(FLAGS + pattern)).alias("at"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, pattern) in enumerate(marks)]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0))["name"]


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once for each row, whatever filter or column refers to them later.

    They come from a generator of one row: a filter on a plain column would be pushed
    below it with its whole expression in place of its name, at each of several levels.
    """
    packed = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    out = df.select("*", F.explode_outer(packed).alias("_held"))
    return out.select(*[F.col(c) for c in df.columns if c not in columns], *[F.col("_held")[n].alias(n) for n in columns])


def once_each(df: DataFrame, text: str, out: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with the column ``out`` that ``make`` adds to a frame of texts; each distinct text is worked on once.

    Both sides are dealt by the text; neither is broadcast, as Spark cannot tell how many
    distinct texts there are. Null texts have a null. ``text`` must be the same whenever it is read.
    """
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("_text")).distinct()
    done = make(texts).select("_text", F.col(out).alias("_out")).hint("merge")
    rows = df.join(done, df[text] == done["_text"], "left")
    return rows.select(*[df[c] for c in df.columns if c != out], F.col("_out").alias(out))
