"""Pay from text, as columns: one rule type, a table of rules, and how their results are united.

A rule is a pattern with named groups (pre, low, high, code, period), the words that must
or must not stand around a match, how the period is found, and what amounts are plausible
for each period. Amounts are cut to whole numbers; hourly ones are in hundredths. Null and
empty texts have no pay; a text without a digit is not searched.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import decimal_number, lookup
from .spans import FLAGS, around, earliest, held, matches, once_each

OFFERS = "array<struct<least:bigint,most:bigint,currency:string,period:string>>"
PAY = "array<struct<start:int,end:int,least:bigint,most:bigint,currency:string,period:string,plausible:boolean>>"

_AMOUNT = r"\d{1,3}(?:[.,'’  ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+(?:[.,]\d{1,2})?(?![\d])"
_DASH = r"\s?(?:-|–|—|\bto\b|\bbis\b|\bdo\b|\bà\b)\s?"


def _low(name: str = "low") -> str:
    return rf"(?P<{name}>(?:{_AMOUNT})k?)(?![\w])"


_RANGE = _low() + _DASH

#: Words that speak of pay, of money that is not pay, and of perks.
SALARY_WORDS = r"\b(salary|salaries|compensation|pay|wage|wages|remuneration|base|ote|gehalt|vergütung|lohn|brutto|gross|salaire|rémunération|wynagrodzenie|mzda|plat|lön|løn|fizetés|bér|salariu|заплата|earn|per (?:hour|year|month|annum)|annual|annually|hourly|monthly|yearly)"
REVENUE_WORDS = r"\b(revenue|funding|raised|valuation|turnover|umsatz|sales of|billion|bn|million|mn|milliard\w*|miljard\w*|miliard\w*|mia\.?|mdr\.?|budget|project)\b"
#: What perks are about and what they are called; a perk names both, close together.
_PERK_TOPICS = ("transport", "commut", "travel", "referral", "recommend", "child", "newborn", "meal", "relocation", "gym", "sport", "tennis", "language")
_PERK_NAMES = ("allowance", "bonus", "reward", "benefit", "compensation", "subsidy", "program", "zuschuss")
_PERK_ALONE = ("zuschuss", "empfehlung", "gift card", "sign-on bonus", "sign on bonus", "signing bonus", "бонус", "ваучер")
PERK_WORDS = "(" + "|".join([*_PERK_ALONE, rf"\b(?:{'|'.join(_PERK_TOPICS)}).{{0,10}}(?:{'|'.join(_PERK_NAMES)})", rf"\bcompensation for .{{0,20}}(?:{'|'.join(_PERK_TOPICS)})"]) + ")"
NET_WORDS = r"\b(netto|net|na rękę|čistého|после данъци)\b"
PROJECT_WORDS = r"\b(budget|project|contract value|turnover)\b"
#: Currency by what stands before the dollar sign.
DOLLARS = {"AU": "AUD", "A": "AUD", "NZ": "NZD", "HK": "HKD", "S": "SGD", "R": "BRL", "MX": "MXN", "U": "USD", "US": "USD", "CDN": "CAD", "C": "CAD", "CA": "CAD"}
CODES = ("AUD", "NZD", "SGD", "HKD", "BRL", "MXN", "CAD", "USD")
#: What marks a period.
PERIOD_MARKS = (
    ("hour", r"(per hour|an hour|hourly|/\s?hour|/\s?hr?\b|stündlich|pro stunde|par heure|de l'heure|na godzinę|na hodinu|per timme|pr\. time|óránként|/óra|pe oră|на час)"),
    ("month", r"(per month|a month|monthly|/\s?month|/\s?mo\b|monatlich|pro monat|mensuel|par mois|miesięcznie|/mies|měsíčně|/měs|per månad|månedlig|pr\. måned|havi|havonta|/hó|lunar|pe lună|месечно|на месец)"),
    ("year", r"(per year|a year|per annum|annually|annual|yearly|/\s?year|/\s?yr\b|jährlich|pro jahr|par an\b|annuel|p\.a\.|rocznie|ročně|årligen|per år|årligt|pr\. år|évente|/év|anual|pe an\b|годишно|на година)"),
)
_STARTS = tuple((name, r"^[\s,(]*" + pattern) for name, pattern in PERIOD_MARKS)


@dataclass(frozen=True)
class Rule:
    """How one shape of pay is read; ``steps`` are (amount below, period or None) where no mark says the period."""

    pattern: str
    currency: str | None
    bounds: dict[str, tuple[float, float]]
    before: int = 0
    after: int = 0
    need: str | None = None
    reject: tuple[str, ...] = ()
    #: Where a mark of the period is looked for: in the window, at the start of the characters after, or in the period group.
    marks: str = "window"
    steps: tuple[tuple[float, str | None], ...] = ()
    both_ends: bool = True
    #: How far the upper end may exceed the greatest plausible amount.
    over: float = 1.0
    #: Whether the currency, its steps and its bounds come from ``TABLED``.
    tabled: bool = False
    #: Lower-case literals of which a text must hold one: a plain search that spares most patterns.
    hints: tuple[str, ...] = ()
    groups: tuple[str, ...] = field(default=())


def _currency(rule: Rule, m: Column) -> Column:
    """What stands before the dollar sign, else the code beside the amount, else the rule's own; in the table, what the sign stands for."""
    if rule.tabled:
        return F.coalesce(*[F.when(m["code"].rlike(f"{FLAGS}^(?:{row[0]})"), code) for code, row in TABLED.items()])
    named = F.lit(None).cast("string")
    if "pre" in rule.groups:
        named = lookup(F.upper(m["pre"]), DOLLARS)
    if "code" in rule.groups:
        named = F.coalesce(named, F.upper(F.nullif(m["code"], F.lit(""))))
    return F.coalesce(named, F.lit(rule.currency))


def _stepped(steps: tuple[tuple[float, str | None], ...], least: Column) -> Column:
    out = F.lit(None).cast("string")
    for limit, name in reversed(steps):
        out = F.when(least < limit, F.lit(name)).otherwise(out)
    return out


def found(text: Column, low: Column, rule: Rule) -> Column:
    """All pay that has the shape of one rule, and whether it is plausible; each step is a transform, so that no step repeats the one before."""
    double = "high" in rule.groups

    def read(m: Column) -> Column:
        k = m["high"].rlike("(?i)k$") & ~m["low"].rlike("(?i)k$") if double else F.lit(False)
        if rule.marks == "window":
            near, marks = around(text, m, rule.before, rule.after), PERIOD_MARKS
        elif rule.marks == "after":
            near, marks = F.substr(text, m["end"] + 1, F.lit(rule.after)), _STARTS
        else:
            near, marks = m["period"], PERIOD_MARKS
        window = around(text, m, rule.before, rule.after) if rule.need or rule.reject else F.lit("")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), decimal_number(m["low"]).alias("low"), decimal_number(m["high" if double else "low"]).alias("high"), k.alias("k"), _currency(rule, m).alias("currency"), earliest(near, marks).alias("marked"), window.alias("window"))

    def in_thousands(r: Column) -> Column:  # 85 - 95K
        return F.struct(r["start"], r["end"], F.when(r["k"] & (r["low"] < 1000), r["low"] * 1000).otherwise(r["low"]).alias("low"), r["high"], r["currency"], r["marked"], r["window"])

    def timed(r: Column) -> Column:
        if rule.tabled:
            steps = F.coalesce(*[F.when(r["currency"] == code, _stepped(((row[2][0], None), (row[3][0], "month"), (_INF, "year")), r["low"])) for code, row in TABLED.items()])
        else:
            steps = _stepped(rule.steps, r["low"])
        return F.struct(r["start"], r["end"], r["low"], r["high"], r["currency"], F.coalesce(r["marked"], steps).alias("period"), r["window"])

    def sized(r: Column, bounds: dict[str, tuple[float, float]]) -> Column:
        end = r["high"] if rule.both_ends else r["low"]
        return reduce(Column.__or__, [(r["period"] == p) & (r["low"] >= lo) & (end <= hi * rule.over) for p, (lo, hi) in bounds.items()])

    def plausible(r: Column) -> Column:
        ok = r["high"] >= r["low"]
        if rule.need:
            ok &= r["window"].rlike(FLAGS + rule.need)
        for words in rule.reject:
            ok &= ~r["window"].rlike(FLAGS + words)
        if rule.tabled:
            size = reduce(Column.__or__, [(r["currency"] == code) & sized(r, dict(zip(("hour", "month", "year"), row[1:]))) for code, row in TABLED.items()])
        else:
            size = sized(r, rule.bounds)
        return F.coalesce(ok & size, F.lit(False))

    def whole(r: Column) -> Column:
        times = F.when(r["period"] == "hour", 100).otherwise(1)
        return F.struct(r["start"], r["end"], (r["low"] * times).cast("bigint").alias("least"), (r["high"] * times).cast("bigint").alias("most"), r["currency"], r["period"], plausible(r).alias("plausible"))

    out = matches(text, rule.pattern)
    for step in (read, *((in_thousands,) if double else ()), timed):
        out = F.transform(out, step)
    hinted = reduce(Column.__or__, [F.contains(low, F.lit(h)) for h in rule.hints])
    return F.when(hinted, F.transform(out, whole).cast(PAY)).otherwise(F.array().cast(PAY))


def _rule(pattern: str, *args, **more) -> Rule:
    names = tuple(g for g in ("pre", "low", "high", "code", "period") if f"(?P<{g}>" in pattern)
    return Rule(pattern, *args, **more, groups=names)


_DOLLAR = {"year": (15_000, 1_000_000), "month": (500, 100_000), "hour": (7, 500)}
_EUR = {"hour": (5, 200), "month": (600, 30_000), "year": (10_000, 500_000)}
_GBP = {"hour": (5, 200), "year": (10_000, 500_000)}
_CHF = {"hour": (15, 300), "month": (1200, 30_000), "year": (30_000, 500_000)}
_INF = float("inf")

LOCATED = (_rule(r"\b[A-Z]{2,3}, [A-Z]{2}, [^\n\d–-]{1,60} [–-] " + _RANGE + _low("high") + r" (?P<code>[A-Z]{3}) (?P<period>annually|hourly)", None, {"year": (0, _INF), "hour": (0, _INF)}, marks="group", hints=("annually", "hourly")),)
BARE = (
    _rule(r"(?<![\w$€£.,])" + _RANGE + _low("high") + r"\s(?P<code>AUD|NZD|SGD|HKD|BRL|MXN|CAD|USD|EUR|GBP|CHF)\b(?P<period>(?: (?:per|an?) \w+|/\w+| annually| hourly)?)", None, {"year": (10_000, 1_000_000), "hour": (0, 1_000_000)}, marks="group", steps=((_INF, "year"),), hints=("aud", "nzd", "sgd", "hkd", "brl", "mxn", "cad", "usd", "eur", "gbp", "chf")),
    _rule(r"(?<![\w$€£.,])" + _RANGE + _low("high") + r"\s?(?P<period>\((?:yr|year)\))", "USD", {"year": (10_000, 1_000_000)}, marks="group", steps=((_INF, "year"),), hints=("(yr)", "(year)")),
)
DOLLAR_RANGE = (_rule(r"(?<![\w$])(?P<pre>AU|A|NZ|HK|S|R|MX|US|U|CDN|CA|C)?\$\s?" + _RANGE + r"(?:[A-Z]{0,3}\$)?\s?" + _low("high") + rf"(?:\s?[(\[]?(?P<code>{'|'.join(CODES)})\b[)\]]?)?", "USD", {"year": (15_000, 1_000_000)}, 100, 80, SALARY_WORDS, (REVENUE_WORDS,), "after", ((_INF, "year"),), hints=("$",)),)
DOLLAR_SINGLE = (_rule(r"(?<![\w$])(?P<pre>AU|A|NZ|HK|S|R|MX|US|U|CDN|CA|C)?\$\s?" + _low() + rf"(?:\s?(?P<code>{'|'.join(CODES)})\b)?(?P<period>\s?(?:per|an?|/)\s?(?:hour|hr|month|mo|year|yr|annum))\b", "USD", _DOLLAR, marks="group", hints=("$",)),)
PREFIXED = (_rule(r"(?<![\w$])(?<![-–]\s)(?<![-–])(?P<pre>AU|A|NZ|HK|S|R|MX|CDN|CA|C)\$\s?" + _low() + r"(?!" + _DASH + r"(?:[A-Z]{0,3}\$)?\s?\d)", None, _DOLLAR | {"hour": (5, 500)}, 100, 80, SALARY_WORDS, (REVENUE_WORDS,), "after", ((5, None), (500, "hour"), (15_000, "month"), (_INF, "year")), hints=("$",)),)
_EURO_WORDS = {"before": 200, "after": 100, "need": SALARY_WORDS, "reject": (PERK_WORDS, NET_WORDS), "hints": ("€", "eur")}
_EURO_STEPS = ((1000, "hour"), (10_000, "month"), (_INF, "year"))
_EURO_SINGLE_STEPS = ((800, None), (10_000, "month"), (_INF, "year"))
EUR_RANGE = (
    _rule(r"€\s?" + _RANGE + r"€?\s?" + _low("high"), "EUR", _EUR, steps=_EURO_STEPS, **_EURO_WORDS),
    _rule(r"(?<![\w€.,])" + _low() + r"(?:\s?(?:€|eur\b|euro\b))?" + _DASH + _low("high") + r"\s?(?:€|eur\b|euro\b)", "EUR", _EUR, steps=_EURO_STEPS, **_EURO_WORDS),
    _rule(r"\beur\s" + _RANGE + r"(?:eur\s)?" + _low("high"), "EUR", _EUR, steps=_EURO_STEPS, **_EURO_WORDS),
)
EUR_SINGLE = (
    _rule(r"€\s?" + _low(), "EUR", _EUR, steps=_EURO_SINGLE_STEPS, **_EURO_WORDS),
    _rule(r"(?<![\w€.,])" + _low() + r"\s?(?:€|eur\b|euro\b)", "EUR", _EUR, steps=_EURO_SINGLE_STEPS, **_EURO_WORDS),
    _rule(r"\beur\s" + _low(), "EUR", _EUR, steps=_EURO_SINGLE_STEPS, **_EURO_WORDS),
)
GBP_RANGE = (_rule(r"£\s?" + _RANGE + r"£?\s?" + _low("high"), "GBP", _GBP, 100, 60, SALARY_WORDS, (PROJECT_WORDS,), steps=((7, None), (201, "hour"), (_INF, "year")), hints=("£",)),)
GBP_SINGLE = (
    _rule(r"£\s?" + _low() + r"(?P<period>\s?(?:per|an?|/)\s?(?:hour|hr|year|yr|annum))\b", "GBP", _GBP, marks="group", hints=("£",)),
    _rule(r"(?P<period>hourly|annual) (?:rate|salary|pay):?\s£\s?" + _low(), "GBP", _GBP, marks="group", hints=("£",)),
)
_SWISS = {"before": 150, "after": 100, "need": SALARY_WORDS, "steps": ((500, "hour"), (15_000, "month"), (_INF, "year")), "both_ends": False, "hints": ("chf",)}
CHF_RANGE = (_rule(r"\bCHF\s?" + _low() + r"(?:\.[–-])?" + _DASH + r"(?:CHF\s?)?" + _low("high") + r"(?:\.[–-])?", "CHF", _CHF, **_SWISS),)
CHF_SINGLE = (_rule(r"\bCHF\s?" + _low() + r"(?:\.[–-])?", "CHF", _CHF, **_SWISS),)

#: Signs, then the plausible hourly, monthly and yearly amounts.
TABLED = {
    "PLN": (r"zł|pln\b", (15, 1000), (2000, 150_000), (30_000, 1_500_000)),
    "CZK": (r"kč|czk\b", (80, 3000), (15_000, 500_000), (200_000, 5_000_000)),
    "SEK": (r"sek\b|kronor\b", (80, 3000), (15_000, 500_000), (200_000, 5_000_000)),
    "DKK": (r"dkk\b", (80, 3000), (15_000, 500_000), (200_000, 5_000_000)),
    "HUF": (r"huf\b|ft\b", (1500, 50_000), (200_000, 20_000_000), (1_500_000, 200_000_000)),
    "RON": (r"ron\b|lei\b", (10, 500), (2000, 100_000), (24_000, 1_000_000)),
    "BGN": (r"bgn\b|лв\.?", (5, 200), (1000, 40_000), (12_000, 400_000)),
}


_SIGNS = "|".join(row[0] for row in TABLED.values())
#: Signs that stand before amounts too.
_BEFORE = "|".join(code.lower() + r"\b" for code in TABLED)
_TABLE_WORDS = {"before": 200, "after": 200, "need": SALARY_WORDS, "reject": (PERK_WORDS, REVENUE_WORDS, NET_WORDS), "over": 1.2, "tabled": True, "hints": ("zł", "kč", "лв", "ft", "lei", "kronor", *(c.lower() for c in TABLED))}
TABLED_RANGE = (
    _rule(r"(?<![\w.,])" + _RANGE + _low("high") + rf"\s?(?P<code>{_SIGNS})", None, {}, **_TABLE_WORDS),
    _rule(rf"\b(?P<code>{_BEFORE})\s?" + _RANGE + _low("high"), None, {}, **_TABLE_WORDS),
)
TABLED_SINGLE = (
    _rule(r"(?<![\w.,])" + _low() + rf"\s?(?P<code>{_SIGNS})", None, {}, **_TABLE_WORDS),
    _rule(rf"\b(?P<code>{_BEFORE})\s?" + _low(), None, {}, **_TABLE_WORDS),
)
RANGES = (*DOLLAR_RANGE, *EUR_RANGE, *GBP_RANGE, *CHF_RANGE, *TABLED_RANGE)
SINGLES = (*DOLLAR_SINGLE, *PREFIXED, *EUR_SINGLE, *GBP_SINGLE, *CHF_SINGLE, *TABLED_SINGLE)


def _all(text: Column, low: Column, rules: tuple[Rule, ...]) -> Column:
    return F.concat(*[found(text, low, r) for r in rules]) if rules else F.array().cast(PAY)


def _plain(offers: Column) -> Column:
    """Plausible offers in the order of the text, equal ones once."""
    return F.array_distinct(F.transform(F.array_sort(F.filter(offers, lambda r: r["plausible"])), lambda r: F.struct(r["least"], r["most"], r["currency"], r["period"])))


def _united(df: DataFrame, text: str, out: str, ranges: tuple[Rule, ...], singles: tuple[Rule, ...] = ()) -> DataFrame:
    """``df`` with the plausible ranges, and the single amounts outside of whatever has the shape of a range, in the order of the text.

    Each step is held as a column of its own, so that no pattern is searched twice.
    """
    r, s, low = f"{out}_ranges", f"{out}_singles", f"{out}_low"
    df = held(df, {low: F.lower(text)})
    df = held(df, {r: _all(F.col(text), F.col(low), ranges), s: _all(F.col(text), F.col(low), singles)})
    lone = F.filter(s, lambda x: ~F.exists(r, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    return held(df, {out: _plain(F.concat(r, lone))}).drop(r, s, low)


def _paid(df: DataFrame, text: str, out: str) -> DataFrame:
    digits, located, bare, other = (f"{out}_{n}" for n in ("text", "located", "bare", "other"))
    df = held(df, {digits: F.when(F.col(text).rlike(r"\d"), F.col(text))})
    df = _united(_united(df, digits, located, LOCATED), digits, bare, BARE)
    df = held(df, {digits: F.when((F.size(located) == 0) & (F.size(bare) == 0), F.col(digits))})
    df = _united(df, digits, other, RANGES, SINGLES)
    chosen = F.when(F.size(located) > 0, F.col(located)).when(F.size(bare) > 0, F.col(bare)).otherwise(F.col(other))
    return held(df, {out: chosen}).drop(digits, located, bare, other)


def _none_for_null(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(out, F.array().cast(OFFERS)))


def with_united(df: DataFrame, text: str, out: str, ranges: tuple[Rule, ...], singles: tuple[Rule, ...] = ()) -> DataFrame:
    """``df`` with the plausible ranges, and the single amounts outside of whatever has the shape of a range, in the order of the text."""
    return _none_for_null(once_each(df, text, out, lambda texts: _united(texts, "_text", out, ranges, singles)), out)


def with_pay(df: DataFrame, text: str, out: str = "offers") -> DataFrame:
    """``df`` with array<struct<least,most,currency,period>>: located ranges, else bare ranges, else what all other rules read."""
    return _none_for_null(once_each(df, text, out, lambda texts: _paid(texts, "_text", out)), out)


def usual(offers: str) -> Column:
    """struct<least,most,currency,period> of the currency and period with most entries (of equals the first): least and greatest amount."""
    kinds = F.array_distinct(F.transform(offers, lambda o: F.struct(o["currency"], o["period"])))
    counted = F.transform(kinds, lambda k, i: F.struct(F.size(F.filter(offers, lambda o: (o["currency"] == k["currency"]) & (o["period"] == k["period"]))).alias("n"), (-i).alias("i"), k.alias("kind")))
    best = F.array_max(counted)["kind"]
    own = F.filter(offers, lambda o: (o["currency"] == best["currency"]) & (o["period"] == best["period"]))
    return F.when(F.size(offers) > 0, F.struct(F.array_min(F.transform(own, lambda o: o["least"])).alias("least"), F.array_max(F.transform(own, lambda o: o["most"])).alias("most"), best["currency"].alias("currency"), best["period"].alias("period")))
