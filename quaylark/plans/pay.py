"""Pay extraction over texts made from the postings, with SQL that computes the answer from the numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import salary as P
from ..registry import query
from ..tables import table


def _grouped(n: Column, sign: str = ",") -> Column:
    """Digits in groups of three."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(sign))


def _texts(spark: SparkSession, sf_dir: str, low: Column, high: Column, shapes: list) -> DataFrame:
    """(id, text): the shape of a posting follows from its key; a and b are numbers from its price."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), low.cast("bigint").alias("a"), high.cast("bigint").alias("b"))
    text = F.lit(None).cast("string")
    for i, shape in enumerate(shapes):
        text = F.when(F.col("id") % len(shapes) == i, shape(F.col("a"), F.col("b"))).otherwise(text)
    return rows.select("id", text.alias("text"))


def _rows(offers: DataFrame) -> DataFrame:
    found = offers.select("id", F.posexplode("offers").alias("at", "o"))
    return found.select("id", "at", "o.least", "o.most", "o.currency", "o.period")


def _sql(low: str, high: str, cases: list) -> str:
    """Rows of the shapes that hold pay: cases are (shape, least, most, currency, period[, place][, condition])."""
    parts = []
    for shape, least, most, currency, period, *rest in cases:
        place, where = (rest + [0, "TRUE"][len(rest) :])[:2]
        parts.append(f"SELECT id, ({place})::INTEGER AS at, ({least})::BIGINT AS least, ({most})::BIGINT AS most, '{currency}' AS currency, '{period}' AS period FROM x WHERE {shape} AND {where}")
    return f"WITH x AS (SELECT o_orderkey AS id, ({low})::BIGINT AS a, ({high})::BIGINT AS b FROM orders) " + " UNION ALL ".join(parts)


_s = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _of_key(times: int, width: int, plus: int, square: bool = False) -> Column:
    """A number that follows from the key of a posting."""
    n = F.col("o_orderkey") % width
    return (n * n if square else n) * times + plus


_LOW_SQL, _HIGH_SQL = "o_orderkey % 5000 * 40 + 100", "o_orderkey % 5000 * 40 + 7100"


@query(_sql(_LOW_SQL, _HIGH_SQL, [("id % 4 = 0", "a", "b", "USD", "year"), ("id % 4 = 1", "a * 100", "b * 100", "CAD", "hour")]))
def fn_11_located_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-11: a place before the range, the currency and its period after it."""
    shapes = [
        lambda a, b: _s("USA, WA, Redmond - ", _grouped(a), ".00 - ", _grouped(b), ".00 USD annually"),
        lambda a, b: _s("Where: CAN, ON, Toronto - ", _grouped(a), " - ", _grouped(b), " CAD hourly."),
        lambda a, b: _s("USA, WA, Redmond - ", _grouped(a), " - ", _grouped(b), " USD"),
        lambda a, b: _s("Redmond - ", a, " - ", b, " USD annually"),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(40, 5000, 100), _of_key(40, 5000, 7100), shapes), "text", "offers", P.LOCATED))


@query(_sql(_LOW_SQL, _HIGH_SQL, [
    ("id % 5 = 0", "a", "b", "USD", "year", 0, "a >= 15000"), ("id % 5 = 1", "a", "b", "AUD", "year", 0, "a >= 15000"), ("id % 5 = 2", "a", "b", "CAD", "year", 0, "a >= 15000"),
]))
def fn_12_dollar_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12: dollar ranges with words of pay and none of revenue near; the currency before or beside the amount."""
    shapes = [
        lambda a, b: _s("The salary is $", _grouped(a), " - $", _grouped(b), " plus bonus"),
        lambda a, b: _s("Compensation A$", _grouped(a), " – A$", _grouped(b), " annually"),
        lambda a, b: _s("Base pay: $", _grouped(a), "-", _grouped(b), " (CAD)"),
        lambda a, b: _s("Annual revenue of $", _grouped(a), " - $", _grouped(b)),
        lambda a, b: _s("Tickets cost $", _grouped(a), " - $", _grouped(b)),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(40, 5000, 100), _of_key(40, 5000, 7100), shapes), "text", "offers", P.DOLLAR_RANGE))


@query(_sql(_LOW_SQL, _HIGH_SQL, [
    ("id % 4 = 0", "a", "b", "EUR", "year", 0, "a >= 10000"), ("id % 4 = 1", "a", "b", "USD", "year", 0, "a >= 10000"), ("id % 4 = 2", "a * 100", "b * 100", "USD", "hour"),
]))
def fn_13_bare_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-13: bare ranges beside a currency code; US dollars where only "(yr)" stands there."""
    shapes = [
        lambda a, b: _s("Offer: ", _grouped(a), " - ", _grouped(b), " EUR"),
        lambda a, b: _s("Offer: ", a, " - ", b, " (yr)"),
        lambda a, b: _s("Offer: ", a, "-", b, " USD per hour"),
        lambda a, b: _s("Rooms ", a, " - ", b, " are free"),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(40, 5000, 100), _of_key(40, 5000, 7100), shapes), "text", "offers", P.BARE))


@query(_sql("o_orderkey % 800", "o_orderkey % 800 * 100", [
    ("id % 4 = 0", "a * 100", "a * 100", "USD", "hour", 0, "a BETWEEN 7 AND 500"), ("id % 4 = 1", "b", "b", "CAD", "year", 0, "b BETWEEN 15000 AND 1000000"), ("id % 4 = 2", "b", "b", "NZD", "month", 0, "b BETWEEN 500 AND 100000"),
]))
def fn_14_dollar_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-14: one dollar amount with its period."""
    shapes = [
        lambda a, b: _s("You get $", a, " per hour"),
        lambda a, b: _s("You get $", _grouped(b), " CAD per year"),
        lambda a, b: _s("You get NZ$", _grouped(b), "/month"),
        lambda a, b: _s("You get $", _grouped(b), " once"),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, F.col("o_orderkey") % 800, F.col("o_orderkey") % 800 * 100, shapes), "text", "offers", (), P.DOLLAR_SINGLE))


_PREFIXES = (("A", "AUD"), ("S", "SGD"), ("HK", "HKD"), ("R", "BRL"), ("MX", "MXN"), ("NZ", "NZD"), ("C", "CAD"))
_PREFIXED = [(f"id % 8 = {i}", "CASE WHEN a < 500 THEN a * 100 ELSE a END", "CASE WHEN a < 500 THEN a * 100 ELSE a END", code, period, 0, f"a {where}") for i, (_, code) in enumerate(_PREFIXES) for period, where in (("hour", "BETWEEN 5 AND 499"), ("month", "BETWEEN 500 AND 14999"), ("year", "BETWEEN 15000 AND 1000000"))]


@query(_sql("o_orderkey % 400 * (o_orderkey % 400) * 5", "0", _PREFIXED))
def fn_15_prefixed_dollar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-15: A$, S$, HK$, R$, MX$, NZ$ and C$ amounts outside ranges; the period follows from the amount."""
    shapes = [lambda a, b, p=p: _s("The base salary is ", f"{p}$", _grouped(a, "." if p == "R" else ",")) for p, _ in _PREFIXES]
    shapes.append(lambda a, b: _s("The shop sells A$", _grouped(a)))
    n = F.col("o_orderkey") % 400
    return _rows(P.with_united(_texts(spark, sf_dir, n * n * 5, F.lit(0), shapes), "text", "offers", (), P.PREFIXED))


def _stepped(shape: str, currency: str, steps: str, bounds: dict[str, tuple[int, int]], low: str = "a", high: str = "b", both: bool = True, over: str = "1") -> list:
    """Cases of one shape whose period follows from the amount."""
    end = high if both else low
    return [(shape, f"{low} * {100 if p == 'hour' else 1}", f"{high} * {100 if p == 'hour' else 1}", currency, p, 0, f"({steps}) = '{p}' AND {low} >= {lo} AND {end} <= {hi} * {over}") for p, (lo, hi) in bounds.items()]


_EURO = "CASE WHEN a < 1000 THEN 'hour' WHEN a < 10000 THEN 'month' ELSE 'year' END"
_EURO_ONE = "CASE WHEN a < 800 THEN 'none' WHEN a < 10000 THEN 'month' ELSE 'year' END"
_WIDE_SQL = "o_orderkey % 350 * (o_orderkey % 350) * 3 + 5"


@query(_sql(_WIDE_SQL, f"{_WIDE_SQL} + 90", [
    *_stepped("id % 7 = 0", "EUR", _EURO, P._EUR), *_stepped("id % 7 = 1", "EUR", _EURO, P._EUR), ("id % 7 = 2", "a", "a", "EUR", "month", 0, "a BETWEEN 600 AND 30000"), *_stepped("id % 7 = 3", "EUR", _EURO_ONE, P._EUR, high="a"),
]))
def fn_16_eur(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-16: euro ranges, then single amounts; perks, net pay and texts without words of pay are left out."""
    shapes = [
        lambda a, b: _s("Gehalt: €", _grouped(a, "."), " - €", _grouped(b, ".")),
        lambda a, b: _s("Vergütung ", _grouped(a, "."), " bis ", _grouped(b, "."), " EUR"),
        lambda a, b: _s("Gehalt ", _grouped(a, "."), ",00 € pro Monat"),
        lambda a, b: _s("Lohn: EUR ", _grouped(a, ".")),
        lambda a, b: _s("Gehalt und Zuschuss von ", _grouped(a, "."), " €"),
        lambda a, b: _s("Gehalt ", _grouped(a, "."), " € netto"),
        lambda a, b: _s("Eintritt ", _grouped(a, "."), " - ", _grouped(b, "."), " €"),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(3, 350, 5, True), _of_key(3, 350, 95, True), shapes), "text", "offers", P.EUR_RANGE, P.EUR_SINGLE))


@query(_sql(_WIDE_SQL, f"{_WIDE_SQL} + 90", [
    ("id % 5 = 0", "a", "b", "GBP", "year", 0, "a >= 10000 AND b <= 500000"), ("id % 5 = 0", "a * 100", "b * 100", "GBP", "hour", 0, "a BETWEEN 7 AND 200 AND b <= 200"),
    ("id % 5 = 1", "a", "a", "GBP", "year", 0, "a BETWEEN 10000 AND 500000"), ("id % 5 = 2", "a * 100", "a * 100", "GBP", "hour", 0, "a BETWEEN 5 AND 200"),
]))
def fn_17_gbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-17: pound ranges with words of pay, and single amounts with a period before or after."""
    shapes = [
        lambda a, b: _s("Salary £", _grouped(a), " - £", _grouped(b)),
        lambda a, b: _s("We offer £", _grouped(a), " per annum"),
        lambda a, b: _s("Hourly rate: £", a),
        lambda a, b: _s("The project has a salary budget of £", _grouped(a), " - £", _grouped(b)),
        lambda a, b: _s("Tickets £", _grouped(a), " - £", _grouped(b)),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(3, 350, 5, True), _of_key(3, 350, 95, True), shapes), "text", "offers", P.GBP_RANGE, P.GBP_SINGLE))


_FRANCS = "CASE WHEN a < 500 THEN 'hour' WHEN a < 15000 THEN 'month' ELSE 'year' END"


@query(_sql(_WIDE_SQL, f"{_WIDE_SQL} + 90", [
    *_stepped("id % 4 = 0", "CHF", _FRANCS, P._CHF, both=False), *_stepped("id % 4 = 1", "CHF", _FRANCS, P._CHF, high="a"), ("id % 4 = 2", "a", "b", "CHF", "month", 0, "a BETWEEN 1200 AND 30000"),
]))
def fn_18_chf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-18: Swiss francs with apostrophes and dashes for no cents."""
    shapes = [
        lambda a, b: _s("Lohn CHF ", _grouped(a, "'"), " - ", _grouped(b, "'")),
        lambda a, b: _s("Lohn CHF ", _grouped(a, "’"), ".–"),
        lambda a, b: _s("CHF ", _grouped(a, "'"), ".- bis CHF ", _grouped(b, "'"), ".- monthly"),
        lambda a, b: _s("Ticket CHF ", _grouped(a, "'")),
    ]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(3, 350, 5, True), _of_key(3, 350, 95, True), shapes), "text", "offers", P.CHF_RANGE, P.CHF_SINGLE))


_SAID = {"PLN": ("wynagrodzenie ", " zł"), "CZK": ("mzda ", " Kč"), "SEK": ("lön ", " kronor"), "DKK": ("løn ", " DKK"), "HUF": ("fizetés ", " Ft"), "RON": ("salariu ", " lei"), "BGN": ("заплата ", " лв")}


def _tabled_cases() -> list:
    out = []
    for i, (code, (_, _, month, year)) in enumerate(P.TABLED.items()):
        steps = f"CASE WHEN a < {month[0]} THEN 'none' WHEN a < {year[0]} THEN 'month' ELSE 'year' END"
        out += _stepped(f"id % 9 = {i}", code, steps, {"month": month, "year": year}, over="1.2")
    return [*out, ("id % 9 = 7", "a", "a", "PLN", "month", 0, "a BETWEEN 2000 AND 150000 * 1.2")]


_HUGE_SQL = "o_orderkey % 400 * (o_orderkey % 400) * 40 + 900"


@query(_sql(_HUGE_SQL, f"{_HUGE_SQL} + 90", _tabled_cases()))
def fn_19_tabled_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19: seven currencies by one table of signs and plausible amounts."""
    shapes = [lambda a, b, w=w, s=s: _s(w, _grouped(a, " "), " - ", _grouped(b, " "), s) for w, s in _SAID.values()]
    shapes += [lambda a, b: _s("wynagrodzenie ", _grouped(a, " "), " PLN miesięcznie"), lambda a, b: _s("bilet ", _grouped(a, " "), " - ", _grouped(b, " "), " zł")]
    return _rows(P.with_united(_texts(spark, sf_dir, _of_key(40, 400, 900, True), _of_key(40, 400, 990, True), shapes), "text", "offers", P.TABLED_RANGE, P.TABLED_SINGLE))


@query(_sql(_WIDE_SQL, f"{_WIDE_SQL} + 5000", [
    ("id % 5 = 0", "a", "b", "USD", "year"), ("id % 5 = 1", "a", "b", "EUR", "year", 0, "a >= 10000 AND b <= 500000"), ("id % 5 = 1", "50000", "60000", "USD", "year", "CASE WHEN a >= 10000 THEN 1 ELSE 0 END"),
    ("id % 5 = 2", "a", "b", "GBP", "year", 0, "a >= 10000"), ("id % 5 = 2", "50000", "60000", "USD", "year", 0, "a < 10000"), ("id % 5 = 3", "1550", "1550", "GBP", "hour"), ("id % 5 = 3", "2500", "2500", "USD", "hour", 1),
]))
def fn_10_salary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-10: a located range decides, then a bare one; else ranges and lone amounts of all rules, each once."""
    shapes = [
        lambda a, b: _s("USA, WA, Redmond - ", _grouped(a), " - ", _grouped(b), " USD annually. Salary $50,000 - $60,000"),
        lambda a, b: _s("Gehalt €", _grouped(a, "."), " - €", _grouped(b, "."), " pro Jahr, or a salary of $50,000 - $60,000; again salary $50,000 - $60,000"),
        lambda a, b: _s(_grouped(a), " - ", _grouped(b), " GBP, or a salary of $50,000 - $60,000"),
        lambda a, b: F.lit("pay of £15.50 per hour or $25 per hour"),
        lambda a, b: F.lit("no pay is named"),
    ]
    return _rows(P.with_pay(_texts(spark, sf_dir, _of_key(3, 350, 5, True), _of_key(3, 350, 5005, True), shapes), "text"))


@query(_sql(_WIDE_SQL, "0", [("id % 2 = 0", "60000", "75000", "USD", "year"), ("id % 2 = 1", "20 * 100", "20 * 100", "GBP", "hour")]).replace("(0)::INTEGER AS at, ", ""))
def fn_22_salary_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-22, AGG-33: one offer of a text: the currency and period named most often, from its least to its greatest amount."""
    shapes = [lambda a, b: F.lit("salary of $60,000 - $70,000 or salary of $65,000 - $75,000, Gehalt €50.000 - €55.000"), lambda a, b: _s("pay of £20 per hour; room ", a)]
    offers = P.with_pay(_texts(spark, sf_dir, _of_key(3, 350, 5, True), F.lit(0), shapes), "text").select("id", P.usual("offers").alias("o"))
    return offers.where("o IS NOT NULL").select("id", "o.least", "o.most", "o.currency", "o.period")
