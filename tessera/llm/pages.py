"""Main text of web pages: the maximum-scoring run of tokens.

A page is a sequence of words and tags. Words score positive and tags negative;
how much, each kind of tag by its own, is learned from pages whose markup says
where the content is: the log-odds of standing there. One linear scan finds the
contiguous run with the largest sum, which is the content region. Where its ends
lie within an article or main, the region grows to that element's ends. Elements that never are content (menus, adverts,
forms, comments and the like) are one negative token each, whatever they hold, and are
cut out of the region; an element that is or holds the page's article or main is not one
of them. A page that has nothing else is read again with fewer of these exclusions: first without those
by class, then only without what no browser shows.

Cases: null and empty pages, and pages without words, give the empty text.
Unclosed quotes end where the next tag does; unclosed elements where HTML implies it or their parent ends, a script, style, title, textarea or iframe with the page. Of runs with one sum the first is taken. Repeated rows are read each on their
own. Null keys are kept. Other columns are ignored, also such as are named like the result's. A page is held whole by one task, in time linear in its length but for unclosed elements.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import sampled

#: Pages that weights are learned from, at most, by hash of the id.
SAMPLE = 400
#: Elements that browsers do not show as text, elements that never hold content, and words in class, id or role that say so of any element.
HIDDEN = frozenset("script style noscript template head textarea svg iframe object canvas title datalist".split())
CUT = frozenset("script style noscript template head nav footer aside form button select textarea svg iframe object canvas dialog menu title option datalist".split())
CUT_WORDS = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bno)(?<!\bnot)(?<!\bwith)(?<!\bwithout)(?<!\bhide)[_-])(?:ad|ads|advert\w*|adsbygoogle|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|side-?bar|footer|site-?header|page-?header|masthead|comments?|comment-?list|disqus|replies"
    r"|cookie\w*|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|search|complementary|contentinfo|skip-?link)(?:$|[\s_-])",
    re.I,
)
MAIN = ("article", "main")
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr acronym nobr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
_PARSED = ("noscript", "template")
_BLOCKS = "address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
_SCOPE = frozenset("table td th caption object template button".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())
_LISTED = _SCOPE | frozenset("ul ol menu dl section article aside main nav blockquote form fieldset".split())
#: By opening tag: open elements that it ends, and elements that shield those around them.
_ENDED: dict[str, list[tuple[frozenset[str], frozenset[str]]]] = {
    "li": [(frozenset(("li",)), _LISTED)], "dt": [(frozenset(("dt", "dd")), _LISTED)], "dd": [(frozenset(("dt", "dd")), _LISTED)],
    "option": [(frozenset(("option",)), frozenset(("select", "datalist", "optgroup")))], "optgroup": [(frozenset(("optgroup", "option")), frozenset(("select",)))] * 2,
    "td": [(frozenset(("td", "th")), frozenset(("table", "tr")))], "th": [(frozenset(("td", "th")), frozenset(("table", "tr")))], "tr": [(frozenset(("tr", "caption")), frozenset(("table",)))],
} | {x: [(frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table",)))] for x in ("thead", "tbody", "tfoot")}
for _name in _BLOCKS:
    _ENDED.setdefault(_name, []).append((frozenset(("p",)), _SCOPE))


class Open:
    """The open elements, with where they start."""

    def __init__(self):
        self.names: list[str] = []
        self.starts: list[int] = []
        self.counts: Counter[str] = Counter()

    def cut(self, k: int) -> None:
        for name in self.names[k:]:
            self.counts[name] -= 1
        del self.names[k:], self.starts[k:]

    def push(self, name: str, start: int) -> None:
        self.names.append(name)
        self.starts.append(start)
        self.counts[name] += 1

    def imply(self, name: str) -> None:
        """Ends the elements that an opening tag ends."""
        for ended, shields in _ENDED.get(name, ()):
            if any(self.counts[x] for x in ended):
                for k in range(len(self.names) - 1, -1, -1):
                    if self.names[k] in ended:
                        self.cut(k)
                        break
                    if self.names[k] in shields:
                        break

    def find(self, name: str) -> int | None:
        """The element that a closing tag ends; none if it is a stray one."""
        if not self.counts[name]:
            return None
        for k in range(len(self.names) - 1, -1, -1):
            x = self.names[k]
            if x == name:
                return k
            if name in INLINE and x not in INLINE or x in _SCOPE and name not in _TABLE and name not in ("body", "html") or name == "li" and x in ("ul", "ol"):
                return None
        return None


#: What is cut out: by class as well, by element only, or only what is not shown.
BY_CLASS, BY_ELEMENT, UNSHOWN = 2, 1, 0


def tokens(page: str, level: int = BY_CLASS) -> list[tuple[str, str]]:
    """(kind, text): kind is 'text', a tag such as '<p' or '</p', or 'cut' for a whole element that never is content."""
    out: list[tuple[str, str]] = []
    has_main = re.search(r"<(?:article|main)\b", page, re.I) is not None
    inside, at, n = 0, 0, len(page)
    opened, holders = Open(), _holders(page) if has_main and level else frozenset()

    def text(a: int, b: int) -> None:
        if b > a:
            out.append(("text", entities.unescape(page[a:b])))

    m = _TAG.search(page, at)
    while m:
        text(at, m.start())
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name and not closing:
            cut = name in HIDDEN or level >= BY_ELEMENT and (name in CUT or name == "header" and not inside)
            if not cut and level >= BY_CLASS and "=" in attrs and name not in ("body", "html"):
                cut = CUT_WORDS.search(" ".join(x.strip("\"'") for x in _HINT.findall(attrs))) is not None
            cut = cut and m.start() not in holders
            lasts = name not in VOID and not attrs.endswith("/")
            opened.imply(name)
            if lasts:
                opened.push(name, m.start())
            if cut and lasts:
                at = _close(page, at, name, opened)
                out.append(("cut", ""))
            elif not cut:
                inside += name in MAIN
                out.append((f"<{name}", ""))
        elif name:
            k = opened.find(name)
            if k is not None:
                opened.cut(k)
            out.append((f"</{name}", ""))
            inside = max(0, inside - (name in MAIN))
        m = _TAG.search(page, at) if at < n else None
    text(at, n)
    return out


def _raw_end(page: str, at: int, name: str) -> int | None:
    """Where the text of an element that holds no tags ends; none if its tags count as it is not closed."""
    m = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
    return m.end() if m else None if name in _PARSED else len(page)


def _close(page: str, at: int, name: str, opened: Open) -> int:
    """Where the element opened last, before ``at``, ends: at its own closing tag, or before the tag that implies its end or ends an element around it."""
    base = len(opened.names) - 1
    end = _raw_end(page, at, name) if name in _RAW else None
    while end is None:
        m = _TAG.search(page, at)
        if not m:
            end = len(page)
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name and (m[1] or m[4]):
            k = opened.find(name)
            if k is not None and k <= base:
                end = m.end() if k == base else m.start()
            elif k is not None:
                opened.cut(k)
        elif name:
            opened.imply(name)
            if len(opened.names) <= base:
                end = m.start()
            elif name in _RAW and (after := _raw_end(page, at, name)):
                at = after
            elif name not in VOID and not (m[3] or m[6] or "").endswith("/"):
                opened.push(name, m.start())
    opened.cut(base)
    return end


def _holders(page: str) -> frozenset[int]:
    """Where the page's main and the elements around it start, and its article (the first in the main, or else of the page) and those around that."""
    opened, at = Open(), 0
    main, article = frozenset(), frozenset()
    has_main = re.search(r"<main\b", page, re.I) is not None
    m = _TAG.search(page)
    while m:
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if name and (m[1] or m[4]):
            k = opened.find(name)
            if k is not None:
                opened.cut(k)
        elif name:
            opened.imply(name)
            if name in _RAW and (after := _raw_end(page, at, name)):
                at = after
            elif name not in VOID and not (m[3] or m[6] or "").endswith("/"):
                opened.push(name, m.start())
                if name == "main" and not main:
                    main, article = frozenset(opened.starts), frozenset()
                elif name == "article" and not article:
                    article = frozenset(opened.starts)
                if article and (main or not has_main):
                    break
        m = _TAG.search(page, at)
    return main | article


#: Weights where no labelled page has shown a kind of token; of words and cut elements, and of any other tag.
PRIOR = {"text": 1.0, "cut": -4.0, "<p": -0.2, "</p": -0.2, "<br": -0.1, "<a": -1.5, "</a": -1.5, "<li": -1.0, "</li": -1.0} | {f"{x}{name}": -0.1 for x in ("<", "</") for name in ("b", "i", "em", "strong", "span", "h1", "h2", "h3")}
OTHER_TAG = -0.5
#: Least and largest sizes of learned weights: a word never counts against the content, a tag never for it.
LEAST_WORD, LEAST_TAG, MOST = 0.5, 0.05, 3.0


def _mains(seq: list[tuple[str, str]]) -> list[tuple[int, int]]:
    """From opening to closing tag, the outermost article and main elements."""
    out, depth, start = [], 0, 0
    for k, (kind, _) in enumerate(seq):
        if kind in ("<article", "<main"):
            start = start if depth else k
            depth += 1
        elif kind in ("</article", "</main") and depth:
            depth -= 1
            if not depth:
                out.append((start, k + 1))
    return [*out, (start, len(seq))] if depth else out


def learn(pages: list[str]) -> dict[str, float]:
    """Weights from pages with a main element: what stands in it is content, all the rest of the page is not."""
    inside, outside = Counter(), Counter()
    for page in pages:
        seq = tokens(page, UNSHOWN)
        spans = _mains(seq)
        if not spans:
            continue
        within = [False] * len(seq)
        for a, b in spans:
            within[a:b] = [True] * (b - a)
        for (kind, text), content in zip(seq, within, strict=True):
            (inside if content else outside)[kind] += len(text.split()) if kind == "text" else 1
    if not inside or not outside:
        return dict(PRIOR)
    a, b = sum(inside.values()), sum(outside.values())
    odds = {k: math.log((inside[k] + 0.5) / (a + 1) / ((outside[k] + 0.5) / (b + 1))) for k in inside.keys() | outside.keys() if k != "cut"}
    weights = {k: max(-MOST, min(-LEAST_TAG, v)) for k, v in odds.items() if k != "text"}
    return PRIOR | weights | {"text": min(MOST, max(LEAST_WORD, odds.get("text", 1.0)))}


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run with the largest sum, in one scan; of equal ones, the first. Empty if no sum is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for k, x in enumerate(scores):
        total += x
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, found = total, (start, k + 1)
    return found


def extract(page: str, weights: dict[str, float]) -> str:
    """The text of the content region."""
    for level in (BY_CLASS, BY_ELEMENT, UNSHOWN):
        seq = tokens(page, level)
        a, b = best_run([weights["text"] * len(text.split()) if kind == "text" else weights.get(kind, OTHER_TAG) for kind, text in seq])
        if a < b:
            break
    for start, end in _mains(seq) if a < b else ():
        a, b = start if start <= a < end else a, end if start < b <= end else b
    out = [text if kind == "text" else " " if kind == "cut" or kind.lstrip("</") not in INLINE else "" for kind, text in seq[a:b]]
    return " ".join("".join(out).split())


def main_text(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    rows = pages.select(pages[key].alias("page_id"), pages[url].alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    labelled = rows.where(F.col("html").rlike(r"(?i)<(?:article|main)\b")).select("page_id", "html")
    sample = sampled(labelled, "page_id", SAMPLE, labelled.count()).collect()
    weights = learn([r["html"] for r in sample])

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([extract(p, weights) for p in batch], dtype="object")

    out = rows.select("page_id", "url", text("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
