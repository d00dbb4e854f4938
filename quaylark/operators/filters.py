"""Composable posting filters: each clause is a column, a filter is their conjunction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the posting model.
NO_EXPERIENCE, OPEN_EXPERIENCE = -1, 99
NO_LOCALE = "_none"
SALARY_MOST = 999_999
EMPLOYMENT_TYPES = ("full_time", "part_time", "contract", "internship", "temporary", "volunteer")
WORK_MODES = ("onsite", "hybrid", "remote")


def true() -> Column:
    return F.lit(True)


def visible() -> Column:
    """Postings shown in a flow: content is not known to be missing."""
    return ~F.col("has_content").eqNullSafe(False)


def live() -> Column:
    """Postings shown in the live snapshot."""
    return F.col("is_active") & visible()


def any_of(column: str, values: Sequence) -> Column:
    """An array column shares a value with ``values``; no values filter nothing."""
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))) if values else true()


def one_of(column: str, values: Sequence) -> Column:
    return F.col(column).isin(*values) if values else true()


def salary_between(column: str, low: int | None, high: int | None) -> Column:
    """Inclusive range; applied only where a bound above 0 is given."""
    if not ((low or 0) > 0 or (high or 0) > 0):
        return true()
    return F.col(column).between(max(low or 0, 0), high if (high or 0) > 0 else SALARY_MOST)


def intervals_overlap(least: str, most: str, low: float | None, high: float | None) -> Column:
    """[least, most] meets [low, high], or the row has no information (-1)."""
    if low is None and high is None:
        return true()
    meets = (F.col(least) <= (OPEN_EXPERIENCE if high is None else high)) & (F.col(most) >= (0 if low is None else low))
    return meets | (F.col(least) == NO_EXPERIENCE)


def spoken(column: str, languages: Sequence[str]) -> Column:
    """Language filter; rows of unknown language match every language."""
    return any_of(column, [*languages, NO_LOCALE]) if languages else true()


def spoken_or_empty(column: str, languages: Sequence[str]) -> Column:
    """The same where unknown is an empty array."""
    return (any_of(column, languages) | (F.size(column) == 0)) if languages else true()


@dataclass(frozen=True)
class PostingFilter:
    """Optional clauses; values that are not known to the model are dropped."""

    locations: Sequence[int] = ()
    occupations: Sequence[int] = ()
    technologies: Sequence[str] = ()
    seniorities: Sequence[str] = ()
    employment: Sequence[str] = ()
    modes: Sequence[str] = ()
    companies: Sequence[int] = ()
    salary: tuple[int | None, int | None] = (None, None)
    experience: tuple[float | None, float | None] = (None, None)
    languages: Sequence[str] = ()
    snapshot: bool = True
    columns: dict[str, str] = field(default_factory=dict)

    def column(self) -> Column:
        name = lambda k: self.columns.get(k, k)
        clauses = [
            live() if self.snapshot else visible(),
            any_of(name("location_ids"), self.locations),
            any_of(name("occupation_ids"), self.occupations),
            any_of(name("technology_ids"), self.technologies),
            one_of(name("seniority"), self.seniorities),
            one_of(name("employment_type"), [e for e in self.employment if e in EMPLOYMENT_TYPES]),
            any_of(name("location_types"), [m for m in self.modes if m in WORK_MODES]),
            one_of(name("company_id"), self.companies),
            salary_between(name("salary"), *self.salary),
            intervals_overlap(name("experience_min"), name("experience_max"), *self.experience),
            spoken(name("locales"), self.languages),
        ]
        return reduce(and_, clauses)

    def canonical(self) -> dict[str, object]:
        """Sorted values under a fixed order of keys: equal filters give equal keys."""
        out: dict[str, object] = {}
        for key in ("companies", "employment", "experience", "languages", "locations", "modes", "occupations", "salary", "seniorities", "technologies"):
            value = getattr(self, key)
            if key in ("salary", "experience"):
                if any(v is not None for v in value):
                    out[key] = list(value)
            elif value:
                out[key] = sorted(set(value))
        return out


def changed(pairs: Sequence[tuple[str, str]]) -> Column:
    """Any of the column pairs differs, null counting as a value."""
    return reduce(or_, [~F.col(a).eqNullSafe(F.col(b)) for a, b in pairs])


def matches(column: Column, include: str | None, exclude: str | None, keep_null: bool = False) -> Column:
    """Include and exclude patterns; with ``keep_null`` rows without content pass."""
    clause = true()
    if include:
        clause &= column.rlike(include)
    if exclude:
        clause &= ~column.rlike(exclude)
    return (column.isNull() | clause) if keep_null else F.coalesce(clause, F.lit(False))


def url_kind(url: Column) -> Column:
    """invalid, bare_host, board_homepage or ok."""
    parts = r"^https?://([^/?#\s]+)(/[^?#]*)?(\?[^#]*)?"
    host, path = F.regexp_extract(url, parts, 1), F.regexp_extract(url, parts, 2)
    depth = F.size(F.filter(F.split(path, "/"), lambda p: p != ""))
    return (
        F.when(url.isNull() | (host == "") | ~host.contains("."), "invalid")
        .when((depth == 0) & (F.regexp_extract(url, parts, 3) == ""), "bare_host")
        .when(depth <= 1, "board_homepage")
        .otherwise("ok")
    )


#: Titles of pages that a login, an error or a check stood in for.
GARBAGE_TITLES = ("not logged in", "log in to career profile", "access denied", "just a moment...", "page not found", "404", "403 forbidden", "sign in", "login", "redirecting")


def garbage_title(title: Column) -> Column:
    """Titles of login, error and redirect pages."""
    return F.lower(F.trim(title)).isin(*GARBAGE_TITLES)


def display_key(name: Column) -> Column:
    """Sort key: lower case, accents off, runs of digits padded to four or more places."""
    base = F.translate(F.lower(name), "äáàâãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    return F.regexp_replace(F.regexp_replace(base, r"(\d+)", "000$1"), r"0*(\d{4,})(?!\d)", "$1")


def canonical_json(fields: dict[str, Column]) -> Column:
    """A stored filter as JSON: values sorted, each once, keys in the order of their names; empty fields are left out."""
    kept = {n: F.array_sort(F.array_distinct(c)) for n, c in sorted(fields.items())}
    return F.to_json(F.struct(*[F.when(F.size(c) > 0, c).alias(n) for n, c in kept.items()]))
