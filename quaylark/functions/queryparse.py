"""Free text to structured filters: a greedy parser over small dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Order of kinds, and how many words a phrase of each may have, longest first.
KINDS = (("mode", (3, 2, 1)), ("seniority", (2, 1)), ("technology", (2, 1)), ("place", (3, 2, 1)), ("occupation", (1, 3, 2)))


@dataclass
class ParsedQuery:
    found: dict[str, list[str]] = field(default_factory=dict)
    keywords: list[str] = field(default_factory=list)


def parse(text: str | None, dictionaries: dict[str, dict[str, str]]) -> ParsedQuery:
    """Each kind in turn takes the phrases it knows; what nobody takes is a keyword."""
    words: list[str | None] = (text or "").lower().replace(",", " ").split()
    out = ParsedQuery()
    for kind, sizes in KINDS:
        known = dictionaries.get(kind, {})
        for n in sizes:
            for at in range(len(words) - n + 1):
                phrase = words[at : at + n]
                if None in phrase:
                    continue
                value = known.get(" ".join(phrase))
                if value is not None:
                    if value not in out.found.setdefault(kind, []):
                        out.found[kind].append(value)
                    words[at : at + n] = [None] * n
    out.keywords = [w for w in words if w is not None]
    return out
