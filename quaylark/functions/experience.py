"""Years of experience from text, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import FLAGS, held, matches

#: Units of time in eight languages, and words for experience and for a minimum.
YEAR_UNITS = ("years", "year", "yrs", "yr", "jahren", "jahre", "jahr", "ans", "an", "anni", "anno", "años", "año", "jaar", "jaren", "år")
MONTH_UNITS = ("months", "month", "monaten", "monate", "monat", "mois", "mesi", "mese", "meses", "mes", "maanden", "maand", "månader", "måneder")
EXPERIENCE = ("experience", "erfahrung", "berufserfahrung", "expérience", "experiencia", "esperienza", "ervaring", "erfarenhet", "erfaring")
AT_LEAST = ("at least", "minimum of", "minimum", "min.", "min", "over", "mindestens", "au moins", "al menos", "almeno", "minimo", "minimaal", "minst")


def _any(words: tuple[str, ...]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


_N, _GAP = r"\d{1,2}(?:[.,]\d)?", r"\s?"
_DASH = r"(?:-|–|—|\bto\b)"
_UNIT = rf"[+＋]?\s?(?P<unit>{_any(YEAR_UNITS)}|{_any(MONTH_UNITS)})\b"
_FREE = r"(?<![\d.,–-])"
_WORD = _any(EXPERIENCE)
#: Ranges (each end may have its unit), least numbers said as such, numbers with a word of experience behind or before them.
FAMILIES = (
    _FREE + rf"(?P<low>{_N}){_GAP}{_DASH}{_GAP}(?P<high>{_N})\s?{_UNIT}",
    _FREE + rf"(?P<low>{_N}){_GAP}(?P<lowunit>{_any(MONTH_UNITS)}){_GAP}{_DASH}{_GAP}(?P<high>{_N})\s?{_UNIT}",
    rf"(?:{_any(AT_LEAST)})\s(?P<low>{_N})\s?{_UNIT}",
    _FREE + rf"(?<![–-] )(?<!to )(?P<low>{_N})\s?{_UNIT}(?=[^.\n]{{0,40}}(?:{_WORD}))",
    rf"\b(?:{_WORD})\s(?:(?:von|van|di|de)\s)?(?:(?:{_any(AT_LEAST)})\s)?(?P<low>{_N})\s?{_UNIT}",
)
#: What speaks of the company, its history or its people when it stands before a number.
NOT_ASKED = r"(founded|for over|history|our company|established|warranty|years? old|celebrat)[^.\n]{0,60}$"
MOST = 30
YEARS = "array<struct<low:double,high:double>>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<low,high>> that one family reads; numbers over 30 and those about the company do not count."""
    double = "<high>" in pattern

    def years(number: Column, unit: Column) -> Column:
        """Years with one decimal, halves up; months are twelfths."""
        months = F.lower(unit).isin(*MONTH_UNITS)
        value = F.regexp_replace(number, ",", ".").cast("decimal(6,3)")
        return F.round(F.when(months, value / 12).otherwise(value), 1).cast("double")

    def read(m: Column) -> Column:
        low_unit = m["lowunit"] if "<lowunit>" in pattern else m["unit"]
        high = years(m["high"], m["unit"]) if double else F.expr("cast(null as double)")
        before = F.substr(text, F.greatest(m["start"] - 60, F.lit(0)) + 1, F.least(m["start"], F.lit(60)))
        return F.struct(years(m["low"], low_unit).alias("low"), high.alias("high"), before.alias("before"))

    def asked(r: Column) -> Column:
        ok = (r["low"] <= MOST) & ~r["before"].rlike(FLAGS + NOT_ASKED)
        return ok & (r["high"] >= r["low"]) & (r["high"] <= MOST) if double else ok

    return F.transform(F.filter(F.transform(matches(text, pattern), read), asked), lambda r: F.struct(r["low"], r["high"])).cast(YEARS)


def with_experience(df: DataFrame, text: str, out: str = "experience") -> DataFrame:
    """``df`` with struct<low,high>: the highest minimum of all families (of equals a range); null where none is asked."""
    body = F.when(F.col(text).rlike(r"\d"), F.col(text))
    df = held(df, {f"{out}_text": body})
    every = F.concat(*[found(F.col(f"{out}_text"), p) for p in FAMILIES])
    best = F.array_max(F.transform(every, lambda r: F.struct(r["low"], r["high"].isNotNull().alias("range"), r["high"])))
    df = held(df, {out: best}).drop(f"{out}_text")
    return df.withColumn(out, F.when(F.col(out).isNotNull(), F.struct(F.col(out)["low"].alias("low"), F.col(out)["high"].alias("high"))))
