"""Places from raw strings, by joins with a gazetteer; every distinct string is resolved once.

A raw value may list several strings (``;``). A string is looked up whole, then token by
token (``,``, ``/``, ``|``); ``XX-City`` and tokens of two or three capitals go through a
table of country and state codes. A token to the right gives context: what lies inside a
place of it wins, and a token that only gave context is no result of its own, so
``Dublin, London`` gives two places and ``Dublin, Ireland`` one. Strings that match
nothing stay, with a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import closure
from .scalars import ACCENTED, PLAIN

#: How many times larger a region must be than the city inside it to win over its namesake.
REGION_FACTOR = 10


def variants(name: Column) -> Column:
    """A name in lower case, without accents, without a leading "the" and without a trailing "city"; each form once."""
    low = F.lower(F.trim(name))
    forms = F.array_distinct(F.array(low, F.translate(low, ACCENTED, PLAIN)))
    more = F.transform(forms, lambda f: F.regexp_replace(f, "^the ", ""))
    return F.array_distinct(F.concat(forms, more, F.transform(F.concat(forms, more), lambda f: F.regexp_replace(f, " city$", ""))))


def _tokens(strings: DataFrame, codes: DataFrame) -> DataFrame:
    """(text, at, name): looked-up forms; ``at`` is 0 for the whole string, else 1, 2 ... from the left."""
    text = F.trim("text")
    prefixed = F.regexp_extract(text, r"^([A-Z]{2})-(\S.*)$", 1)
    body = F.when(prefixed != "", F.concat(F.regexp_extract(text, r"^[A-Z]{2}-([^,]*)", 1), F.lit(", "), prefixed)).otherwise(text)
    parts = F.filter(F.transform(F.split(body, "[,/|]"), lambda p: F.trim(p)), lambda p: p != "")
    whole = F.when((F.size(parts) > 1) & (prefixed == ""), text)
    rows = strings.select("text", F.posexplode(F.concat(F.array(whole), parts)).alias("at", "token")).where("token IS NOT NULL")
    coded = rows.join(codes.select(F.upper("code").alias("token"), F.col("name").alias("meant")), "token", "left")
    return coded.select("text", "at", F.explode(variants(F.coalesce("meant", "token"))).alias("name")).distinct()


def _chosen(found: DataFrame) -> DataFrame:
    """One candidate of each (text, at): the country, else city or region by the rule of namesakes, else the larger one."""
    token = Window.partitionBy("text", "at")
    most = lambda cond: F.max(F.when(cond, F.col("population"))).over(token)
    city, region = F.col("kind") == "city", F.col("kind").isin("region", "macro")
    rows = found.withColumn("inside_any", F.max("inside").over(token)).where("inside = inside_any")
    rows = rows.withColumns({"countries": most(F.col("kind") == "country"), "nested_most": most(city & F.col("nested")), "region_most": most(region), "city_most": most(city)})
    by_region = (F.col("nested_most") > 0) & (F.col("nested_most") * REGION_FACTOR < F.col("region_most"))
    right = (
        F.when(F.col("countries").isNotNull(), F.col("kind") == "country")
        .when(F.col("nested_most").isNotNull(), F.when(by_region, region).otherwise(city & F.col("nested")))
        .when(F.col("city_most").isNotNull() & F.col("region_most").isNotNull(), F.when(F.col("city_most") >= F.col("region_most"), city).otherwise(region))
        .when(F.col("city_most").isNotNull(), city)
        .otherwise(True)
    )
    rank = F.struct("spoken", "population", (-F.col("id")).alias("first"))
    return rows.where(right).groupBy("text", "at").agg(F.max_by("id", rank).alias("id"), F.max("inside").alias("inside"))


def resolve(raw: DataFrame, key: str, text: str, names: DataFrame, entries: DataFrame, codes: DataFrame, language: str | None = None) -> DataFrame:
    """(key, text, id) of every string of every row, each place of a string once; unmatched strings with a null id.

    names is (name, id, locale), entries (id, parent_id, kind, population), codes (code, name).
    Of candidates that are alike in all else those with a name in ``language`` win.
    """
    listed = raw.select(key, F.explode(F.array_distinct(F.filter(F.transform(F.split(text, ";"), lambda s: F.trim(s)), lambda s: s != ""))).alias("text"))
    strings = listed.select("text").distinct()
    forms = names.select("id", F.explode(variants(F.col("name"))).alias("name"), (F.col("locale") == language if language else F.lit(False)).alias("own"))
    forms = forms.groupBy("name", "id").agg(F.max("own").alias("spoken"))
    found = _tokens(strings, codes).join(forms, "name").groupBy("text", "at", "id").agg(F.max("spoken").alias("spoken"))
    whole = found.where("at = 0").select("text").distinct().withColumn("is_whole", F.lit(True))
    found = found.join(whole, "text", "left").where(F.coalesce("is_whole", F.lit(False)) == (F.col("at") == 0)).drop("is_whole")
    found = found.join(entries.select("id", "kind", "population"), "id")
    up = closure(entries.select("id", "parent_id")).where("depth > 0").select("id", "ancestor_id")
    above = found.select("text", F.col("at").alias("outer_at"), F.col("id").alias("ancestor_id"), F.col("kind").alias("outer_kind"))
    pairs = found.select("text", "at", "id").join(up, "id").join(above, ["text", "ancestor_id"])
    context = pairs.where("outer_at > at").groupBy("text", "at", "id").agg(F.lit(1).alias("inside"))
    nested = pairs.where("outer_at = at AND outer_kind IN ('region', 'macro')").groupBy("text", "at", "id").agg(F.lit(True).alias("nested"))
    rows = found.join(context, ["text", "at", "id"], "left").join(nested, ["text", "at", "id"], "left").fillna(0, ["inside"]).fillna(False, ["nested"])
    chosen = _chosen(rows)
    # a token gave context if the choice of a token to its left lies inside one of its places
    used = chosen.where("inside = 1").select("text", F.col("at").alias("left_at"), "id").join(up, "id").join(above, ["text", "ancestor_id"]).where("outer_at > left_at")
    results = chosen.join(used.select("text", F.col("outer_at").alias("at")).distinct(), ["text", "at"], "left_anti").select("text", "id").distinct()
    return listed.join(results, "text", "left").select(key, "text", "id")
