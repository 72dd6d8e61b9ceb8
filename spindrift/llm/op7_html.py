"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words, which score positive, and tags, which score
negative; weights are log-odds counted on labelled pages.  One linear scan finds
the contiguous run with the greatest sum.  Inside it, menus, adverts and other
parts that are never main text are left out by their element or its class.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that a fit sees at most.
MAX_FIT_PAGES = 256

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
_SPACED = {"br", "td", "th", "option"}
#: A paragraph or item ends where the next block begins.
_LOOSE = {"p", "dt", "dd"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Never main text: by element, by role, by a word of class or id.
_AWAY = {"head", "nav", "aside", "footer", "form", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "menu"} | _RAW
_AWAY_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_AWAY_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies", "gdpr", "popup", "modal",
    "newsletter", "sidebar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "comment", "comments", "replies", "share",
    "sharing", "social", "pagination", "pager",
}
#: Words that an article's own blocks bear too: they count outside one only.
_AWAY_OUTSIDE = {
    "header", "promotion", "banner", "consent", "notice", "notices", "alert", "subscribe", "signup", "menu", "masthead", "topbar", "reply", "related",
    "recommended", "widget", "widgets", "toolbar", "login", "search", "skip",
}
#: Words that say what kind of part it is, not what it is about: in a compound they
#: may stand beside one of the words above.
_PART_WORDS = {
    "area", "bar", "block", "box", "button", "buttons", "container", "content", "form", "icons", "inner", "item", "items", "label", "left", "link", "links",
    "list", "main", "outer", "page", "panel", "right", "row", "section", "site", "slot", "thread", "top", "bottom", "unit", "wrap", "wrapper",
}


@dataclass
class Weights:
    """Scores of words by the block they stand in, and of tags by name."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, block: str) -> float:
        return self.words.get(block, 1.0)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.3 if name in _BLOCK else -0.05)


#: (kind, text or tag name, block around it, kept): kind 0 text, 1 tag.
Event = tuple[int, str, str, bool]


def _named_away(token: str, inside: bool) -> bool:
    """Whether a class or id says that a part isn't main text.

    Each word of a compound must say so or be about the form of the part, so
    ``ad-slot`` does and ``share-price`` doesn't.
    """
    words = [w for w in re.split(r"[^a-z0-9]+", token) if w and not w.isdigit()]
    away = _AWAY_WORDS if inside else _AWAY_WORDS | _AWAY_OUTSIDE
    return any(w in away for w in words) and all(w in _AWAY_WORDS or w in _AWAY_OUTSIDE or w in _PART_WORDS for w in words)


def _away(name: str, rest: str, inside: bool, quoted: bool) -> bool:
    """``inside`` an article or main, ``quoted`` in a block quotation, whose footer is
    its source."""
    if name in _AWAY and not (name == "footer" and quoted) or name == "header" and not inside:
        return True
    if name in ("html", "body", "article", "main") or not rest:
        return False
    for m in _ATTRIBUTE.finditer(rest):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "role" and value in _AWAY_ROLES or key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id"):
            if any(_named_away(token, inside) for token in value.split()):
                return True
    return False


def events(page: str) -> list[Event]:
    """Texts and tags of a page, in order.  What never is main text is one tag."""
    out: list[Event] = []
    stack: list[tuple[str, bool, str]] = []  # open elements, whether they are kept, the block they are in
    opened: Counter[str] = Counter()  # their names
    at, n = 0, len(page)

    def state() -> tuple[str, bool, str]:
        return stack[-1] if stack else ("body", True, "body")

    def pop() -> str:
        name = stack.pop()[0]
        opened[name] -= 1
        return name

    def text(s: str) -> None:
        if s:
            out.append((0, html.unescape(s), state()[2], state()[1]))

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        rest = m["rest"] if m["name"] else m["rest2"]
        kept = state()[1]
        if m["close"] or m["close2"]:
            if opened[name]:
                while pop() != name:
                    pass
            if kept:
                out.append((1, name, "", True))
            elif state()[1]:  # the part that was left out ends
                out.append((1, name, "", True))
            continue
        if name in _BLOCK:
            while stack and stack[-1][0] in _LOOSE or stack and stack[-1][0] not in _BLOCK and any(opened[x] for x in _LOOSE):
                pop()
            if name == "li" and stack and stack[-1][0] == "li":
                pop()
            kept = state()[1]
        if kept:
            out.append((1, name, "", True))
        if name in _VOID or rest.endswith("/"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        inside = opened["article"] + opened["main"] > 0
        stack.append((name, kept and not _away(name, rest, inside, opened["blockquote"] > 0), name if name in _BLOCK else state()[2]))
        opened[name] += 1
    return out


def _score(e: Event, weights: Weights) -> float:
    kind, s, block, kept = e
    if kind:
        return weights.tag(s)
    return weights.word(block) * len(s.split()) if kept else 0.0


def best_run(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest positive sum.

    The first such run, and of those that start together the shortest; (0, 0) if
    no sum is over 0.
    """
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    found = events(page or "")
    start, end = best_run([_score(e, weights) for e in found])
    blocks: list[list[str]] = [[]]
    for kind, s, _, kept in found[start:end]:
        if kind == 0:
            if kept:
                blocks[-1].append(s)
        elif s in _BLOCK:
            blocks.append([])
        elif s in _SPACED:
            blocks[-1].append(" ")
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def fit_weights(labelled: list[tuple[str, str]]) -> Weights:
    """Log-odds of being inside the main text, from (page, text) pairs.

    The inside of a page is the least run of events that holds the text's words
    in a row, with headings right before it.  Pages without such a run
    teach nothing; with none at all the weights are the built-in ones.
    """
    inside, outside = [Counter(), Counter()], [Counter(), Counter()]
    for page, text in labelled:
        found, want = events(page or ""), (text or "").split()
        words = [(w, i) for i, (kind, s, _, kept) in enumerate(found) if kind == 0 and kept for w in s.split()]
        flat = [w for w, _ in words]
        first = next((i for i in range(len(flat) - len(want), -1, -1) if flat[i : i + 1] == want[:1] and flat[i : i + len(want)] == want), None) if want else None
        if first is None:
            continue
        lo, hi = words[first][1], words[first + len(want) - 1][1]
        while lo > 0 and (found[lo - 1][0] == 1 and found[lo - 1][1] not in _AWAY | {"article", "main", "div", "section"} or found[lo - 1][2] in _HEADINGS):
            lo -= 1
        for i, (kind, s, block, kept) in enumerate(found):
            side = inside if lo <= i <= hi else outside
            if kind:
                side[1][s] += 1
            elif kept:
                side[0][block] += len(s.split())
    odds = lambda k, x: math.log((inside[k][x] + 1) / (outside[k][x] + 1))
    words = {b: min(1.0, max(0.0, odds(0, b))) for b in inside[0] | outside[0] if inside[0][b] + outside[0][b]}
    tags = {t: max(-3.0, min(-0.05, odds(1, t))) for t in inside[1] | outside[1] if inside[1][t] + outside[1][t]}
    return Weights(words, tags)


def labelled_pages(pages: DataFrame, documents: DataFrame, most: int = MAX_FIT_PAGES) -> list[tuple[str, str]]:
    """Up to ``most`` pages, first by an MD5 of ``page_id``, whose address names
    the document they show, with its text."""
    some = pages.select("page_id", "html", F.regexp_extract("url", r"://[^/]+/(?:[a-z]+/)*(\d+)", 1).alias("id")).where("id <> '' and html is not null")
    some = some.orderBy(F.md5(F.col("page_id").cast("string"))).limit(most)
    known = documents.select(F.col("doc_id").cast("string").alias("id"), "text").join(F.broadcast(some), "id")  # at most `most` pages
    return [(r["html"], r["text"]) for r in known.select("html", "text").limit(most).toLocalIterator()]


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """All rows of ``pages`` with ``text`` and ``n_chars`` (code points) added.

    Null or empty html has empty text, as has a page without words in any part
    that may be main text.  Character references are decoded, white space inside
    a block becomes one space, blocks are trimmed and joined by one line feed;
    repeated blocks and rows stay.  Input columns named ``text`` or ``n_chars``
    are replaced, others pass unchanged.
    """
    weights = weights or Weights()
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    pages = pages.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                texts = [main_text(x, weights) for x in batch.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, f"{schema}, text string, n_chars long")
