"""HTML as a tree that any input gives, and two normal forms of it.

The tree builder never fails: start tags close what cannot hold them (a paragraph before a
block, an item before the next one, cells and rows), end tags without a start are counted
and left out, open elements end with their parents. Where the tokenizer itself gives up,
the rest of the page becomes text and the page is marked as broken.

``clean`` keeps the structure of a description (allowed tags without attributes, others
unwrapped, unsafe subtrees gone); ``labelled`` makes blocks for labelling: four levels of
headings become three, bold and italic their semantic forms, naked text paragraphs, empty
blocks go, and links keep their address. Both keep all visible text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..batches import rows_of_texts

#: Subtrees that go, and tags that stay, in descriptions and in texts for labelling.
DROPPED = frozenset("script style noscript iframe object embed svg math canvas template head".split())
ALLOWED = frozenset("a b blockquote br code em h1 h2 h3 h4 h5 h6 hr i li ol p pre s strong u ul".split())
LABEL_DROPPED = frozenset("script style noscript head meta link svg iframe object embed".split())
LABEL_ALLOWED = frozenset("p ul ol li h2 h3 h4 strong em a br blockquote".split())
LABEL_BLOCKS = frozenset("p ul ol h2 h3 h4 blockquote".split())
LABEL_INLINE = frozenset("strong em a br".split())
RENAMED = {"h1": "h2", "h5": "h4", "h6": "h4", "b": "strong", "i": "em"}
#: Elements without content, those before which a paragraph ends, and what ends what (up to a border).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tr"}, {"table"}), "thead": ({"tbody", "tr"}, {"table"}), "tfoot": ({"tbody", "tr"}, {"table"}), "body": ({"head"}, {"body"}),
}
_P_BORDER = _BLOCKS - {"p"} | {"td", "th", "li", "dd", "dt", "button", "svg", "math", "object", "template"}
_ESCAPED = re.compile(r"&lt;\s*/?\s*(?:p|h[1-6]|ul|ol|li|a|strong|em|b|i|u|s|br|blockquote|pre|code)\b", re.I)
#: Elements open at once; deeper ones are siblings, so that no page makes the walk too deep.
DEEPEST = 200


@dataclass
class Node:
    """An element with its children, or a text (tag empty)."""

    tag: str = ""
    text: str = ""
    href: str | None = None
    children: list[Node] = field(default_factory=list)

    def all_text(self) -> str:
        return self.text if not self.tag else "".join(c.all_text() for c in self.children)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.problems = 0

    def _end(self, tags: set[str] | frozenset[str], border: set[str] | frozenset[str]) -> None:
        """End the innermost open element of ``tags`` and all within it, unless a border lies between."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in border:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _BLOCKS:
            self._end({"p"}, _P_BORDER)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
            if tag in ("tr", "tbody", "thead", "tfoot"):  # a row also ends the cell that holds it open
                self._end({"tr"} if tag != "tr" else set(), {"table"})
        node = Node(tag, href=dict(attrs).get("href") if tag == "a" else None)
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends void elements only

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        border = {"table"} if tag in ("tr", "td", "th") else {"td", "th"} if tag not in ("table", "tbody", "thead", "tfoot", "body", "html") else set()
        before = len(self.open)
        self._end({tag}, border)
        self.problems += len(self.open) == before

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(Node(text=data))


def parse(html: str) -> tuple[Node, int, bool]:
    """The tree, the number of end tags without a start, and whether the tokenizer gave up (the rest is text then)."""
    builder, broken = _Builder(), False
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError, NotImplementedError):
        broken = True
        builder.handle_data(re.sub(r"<[^>]*>", " ", builder.rawdata))
    return builder.root, builder.problems, broken


def _kept(node: Node, allowed: frozenset[str], dropped: frozenset[str], renamed: dict[str, str]) -> list[Node]:
    """What stays of a node: itself with what stays of its children, or these alone."""
    if not node.tag:
        return [node]
    if node.tag in dropped:
        return []
    inner = [k for c in node.children for k in _kept(c, allowed, dropped, renamed)]
    tag = renamed.get(node.tag, node.tag)
    return [Node(tag, href=node.href, children=inner)] if tag in allowed else inner


def _written(nodes: list[Node], links: bool) -> str:
    out = []
    for n in nodes:
        if not n.tag:
            out.append(entities.escape(n.text, quote=False))
        elif n.tag in VOID:
            out.append(f"<{n.tag}>")
        else:
            href = f' href="{entities.escape(n.href)}"' if links and n.href is not None else ""
            out.append(f"<{n.tag}{href}>{_written(n.children, links)}</{n.tag}>")
    return "".join(out)


def clean(html: str | None) -> str | None:
    """A description with allowed tags only, without attributes; null for null, for blanks and for nothing left."""
    raw = (html or "").strip()
    if _ESCAPED.search(raw):
        raw = entities.unescape(raw)
    root, _, _ = parse(raw)
    nodes = [k for c in root.children for k in _kept(c, ALLOWED, DROPPED, {})]
    return _written(nodes, False).replace(" ", " ").strip() or None


def _has_block(nodes: list[Node]) -> bool:
    return any(n.tag in LABEL_BLOCKS or _has_block(n.children) for n in nodes)


def _without_empty(nodes: list[Node]) -> list[Node]:
    out = []
    for n in nodes:
        n.children = _without_empty(n.children)
        if n.tag not in LABEL_BLOCKS or n.all_text().strip():
            out.append(n)
    return out


def _paragraphs(text: str) -> list[str]:
    """Parts between empty lines; where there are none, lines."""
    parts = [p.strip() for p in re.split(r"\n\s*\n+", text) if p.strip()]
    return parts if len(parts) > 1 else [p.strip() for p in text.split("\n") if p.strip()]


def _wrapped(nodes: list[Node]) -> list[Node]:
    """Runs of naked text and inline elements as paragraphs."""
    out: list[Node] = []
    run: list[Node] = []
    for n in [*nodes, None]:
        if n is not None and (not n.tag or n.tag in LABEL_INLINE):
            if n.tag or n.text.strip():
                run.append(n)
            continue
        if run:
            out.append(Node("p", children=run))
            run = []
        if n is not None:
            out.append(n)
    return out


def labelled(html: str | None) -> tuple[str, str]:
    """(html, text) for labelling: blocks a line each, and their plain text; empty for null and blanks."""
    if not html or not html.strip():
        return "", ""
    root, _, _ = parse(html)
    nodes = [k for c in root.children for k in _kept(c, LABEL_ALLOWED, LABEL_DROPPED, RENAMED)]
    if not _has_block(nodes):
        parts = _paragraphs("".join(n.all_text() for n in nodes))
        if len(parts) > 1:
            nodes = [Node("p", children=[Node(text=p)]) for p in parts]
    nodes = _wrapped(_without_empty(nodes))
    out = re.sub(r"[ \t]+", " ", _written(nodes, True))
    out = re.sub(r"(</(?:p|ul|ol|h2|h3|h4|blockquote|li)>)", r"\1\n", out)
    out = re.sub(r"\n\s*\n", "\n", out).strip()
    text = "\n".join(_texts(parse(out)[0]))
    return out, re.sub(r"\n\s*\n+", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()


def _texts(node: Node) -> Iterator[str]:
    if not node.tag:
        yield node.text
    for c in node.children:
        yield from _texts(c)


def visible_text(html: str) -> str:
    """The text of a page without dropped subtrees, blanks collapsed."""
    root, _, _ = parse(html)
    kept = [k for c in root.children for k in _kept(c, frozenset(), LABEL_DROPPED, {})]
    return " ".join(" ".join(n.text for n in kept).split())


def coverage(html: str | None, text: str) -> float:
    """Share of a page's visible text that ``text`` holds, by length; 1 for an empty page."""
    raw = visible_text(html or "")
    return min(1.0, len(" ".join(text.split())) / len(raw)) if raw else 1.0


FORMS = T.StructType([T.StructField(n, t) for n, t in (("clean", T.StringType()), ("labelled", T.StringType()), ("text", T.StringType()), ("coverage", T.DoubleType()), ("strays", T.IntegerType()), ("broken", T.BooleanType()))])


def normalised(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, clean, labelled, text, coverage, strays, broken) of every page, a megabyte of pages at a time.

    ``strays`` counts end tags without a start; ``broken`` marks pages whose rest was taken as
    text. A null page has null forms and no strays. Repeated keys and pages are rows of their own.
    """

    def forms(page: str | None) -> Iterator[tuple]:
        if page is None:
            yield None, None, None, None, 0, False
            return
        _, strays, broken = parse(page)
        form, text = labelled(page)
        yield clean(page), form, text, coverage(page, text), strays, broken

    return rows_of_texts(pages, key, html, FORMS, forms)


def cleaned(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, clean) as ``normalised`` gives them; a page is parsed once, and no other form of it is made."""
    return rows_of_texts(pages, key, html, FORMS[:1], lambda page: [(clean(page),)])
