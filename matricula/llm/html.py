"""Main text of web pages by tag-path ratios.

A page is read into blocks of text; a block's path is the chain of its open elements from the root,
with their classes. Parts that name themselves navigation, advert, form or the like are left out.
Over the other blocks, text length, punctuation and link text are summed per path. The ratios per
block of a path are fused into one score, and the blocks of paths above a threshold are content, in all elements that
name themselves the article, or on the whole page if none does. With them stay headings before content, short blocks between
content, and those around it that reach the threshold by the scores smoothed over the page order, unless
their own classes set them apart. In an element that names itself the article, classes set apart only labels of a word or two, and
what stands before the first content.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matricula.llm.base import pieces, small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'=<>`]+\Z")  # a last value without quotes, to which a final / belongs

# Element names of HTML by role.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math select object".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split()
)
_OUT = frozenset("nav footer aside form button menu dialog head fieldset".split())
_CLOSES = {  # a start tag ends an open element of these names, up to one of the others
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words of a class, id or role by which a part says that it is not the article (fixed values).
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar aside rail widget widgets footer foot masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social comment comments commentlist disqus respond reply replies discussion related recommended "
    "recommendations teaser pagination pager search form copyright legal contentinfo complementary skip hidden header".split()
)
_MAIN_WORDS = frozenset("article articlebody main mainarticle post entry story".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TEXT = _HEADINGS | frozenset("p li dt dd td th blockquote pre figcaption caption summary".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")


class _Open:
    """An open element. ``step`` and ``path`` name it and its chain of block elements, ``parent`` is the block element around it,
    ``depth`` their number. The flags hold for it or any element around it: left out, main, link, heading, an element of the page's body."""

    __slots__ = ("tag", "step", "path", "parent", "depth", "classed", "out", "main", "link", "heading", "real")

    def __init__(self, tag, step, classed, out, main, around: _Open | None, paths: dict):
        self.tag, self.step, self.classed, self.out, self.main = tag, step, classed, out, main
        if around is None:
            self.path, self.parent, self.depth, self.link, self.heading, self.real = 0, None, 0, False, False, False
            return
        self.link = around.link or tag == "a"
        if tag in _INLINE:  # no step of the path
            self.parent, self.depth, self.path, self.heading, self.real = around.block(), around.depth, around.path, around.heading, around.real
            return
        self.parent, self.depth = around.block(), around.depth + 1
        self.path = paths.setdefault((around.path, step), len(paths) + 1)
        self.heading = around.heading or tag in _HEADINGS
        self.real = around.real or tag not in ("html", "body")

    def block(self) -> _Open:
        """The element itself, or the block element around an inline one."""
        return self.parent if self.tag in _INLINE else self


def _element(tag: str, attrs: str, around: _Open, paths: dict) -> _Open:
    words, main, hidden, step = set(), tag in ("article", "main"), False, tag
    for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id", "role", "itemprop"):
            words.update(x for x in re.split(r"[\s_-]+", value) if x)
            main = main or value.replace("-", "").replace("_", "") in _MAIN_WORDS
            step += f".{value.strip()}" if name == "class" else ""
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            hidden = True
    named_out = bool(words & _OUT_WORDS) and not main and tag not in ("html", "body")
    head = (tag == "header" or words & {"header"}) and around.main  # a header inside the article holds its title
    out = around.out or hidden or tag in _OUT or (tag == "header" and not head) or (named_out and not head)
    return _Open(tag, step, step != tag, out, around.main or main, around, paths)


def blocks(page: str) -> list[dict]:
    """The blocks of a page in order: ``text`` (white space collapsed), ``path`` (a number), ``node`` (the block element that
    holds it) and ``link`` (characters of links). Blocks that are left out or empty are not listed."""
    paths: dict = {}
    stack, done = [_Open("", "", False, False, False, None, paths)], []
    opened: Counter = Counter()  # open elements by name
    current: dict | None = None

    def finish():
        nonlocal current
        if current:
            text = " ".join("".join(current["parts"]).split())
            if text:
                done.append(current | {"text": text, "link": min(current["link"], len(text))})
        current = None

    def add(raw: str):
        nonlocal current
        top = stack[-1]
        if top.out or not raw:
            return
        text = html.unescape(raw)
        if current is None:
            if not text.strip():
                return
            current = {"parts": [], "link": 0, "path": top.path, "node": top.block()}
        current["parts"].append(text)
        if top.link:
            current["link"] += len(" ".join(text.split()))

    def close_to(k: int):
        if any(e.tag not in _INLINE for e in stack[k:]):
            finish()
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close_to(k)
                    break
                if tag in _INLINE and stack[k].tag not in _INLINE:
                    break  # an inline end tag does not end a block
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                finish()
            continue
        if tag in ("svg", "math") and m["attrs"].endswith("/") and not _UNQUOTED.search(m["attrs"]):
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag not in _INLINE:
            close, stop = _CLOSES.get(tag, ({"p"}, {"td", "th", "table", "button"}))
            for names, until in ((close, stop), ({"p"}, {"td", "th", "table", "button"})):
                for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in names) else ():
                    if stack[k].tag in names:
                        close_to(k)
                        break
                    if stack[k].tag in until:
                        break
            finish()
        stack.append(_element(tag, m["attrs"], stack[-1], paths))
        opened[tag] += 1
    finish()
    return done


def path_ratios(found: list[dict]) -> list[float]:
    """Fused tag-path ratio of each block."""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(b["path"], [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b["text"])
        s[2] += len(_PUNCTUATION.findall(b["text"]))
        s[3] += b["link"]
    fused = {p: (size / n) * (1 + marks / n) * (1 - link / size) ** 2 for p, (n, size, marks, link) in sums.items()}
    return [fused[b["path"]] for b in found]


def path_scores(found: list[dict]) -> list[float]:
    """Smoothed fused tag-path ratio of each block."""
    raw = path_ratios(found)
    return [
        (0.25 * raw[max(0, i - 1)] + 0.5 * raw[i] + 0.25 * raw[min(len(raw) - 1, i + 1)]) if len(raw) > 1 else raw[i]
        for i in range(len(raw))
    ]


def _joins(block: dict, content: dict) -> tuple[bool, bool, bool]:
    """Whether a block stands with a content block in one container, whether no class sets it apart from that, and whether
    that is in a main element."""
    a, b, classed = block["node"], content["node"], False
    depth = b.depth
    while a is not b:  # up to the element around both
        if a.depth >= b.depth:
            classed |= a.classed
            a = a.parent
        else:
            b = b.parent
    within = a.depth >= depth - 1 or a.real  # beside it, or in an element beside it
    return within, not classed, a.main


def _label(text: str) -> bool:
    """One or two words without a digit or punctuation, as buttons and tags have."""
    return len(text.split()) <= 2 and not re.search(r"[^\w\s]|\d|_", text)


def main_text(page: str | None, threshold: float = 0.1) -> str:
    """The article of a page: blocks joined by line breaks, empty if there is none.

    ``threshold``: least score of a content path by the best one."""
    found = blocks(page or "")
    link: dict[int, list[float]] = {}
    for b in found:
        x = link.setdefault(b["path"], [0, 0])
        x[0] += b["link"]
        x[1] += len(b["text"])
    menu = {p for p, (a, n) in link.items() if a > 0.6 * n}
    found = [b for b in found if b["path"] not in menu]
    if not found:
        return ""
    ratio = path_ratios(found)
    best, inside = max(ratio), [b["node"].main for b in found]
    if any(i and r >= threshold * best for i, r in zip(inside, ratio, strict=True)):
        found = [b for b, i in zip(found, inside, strict=True) if i]
    ratio, score = path_ratios(found), path_scores(found)
    best_of: dict[int, float] = {}
    for b, s in zip(found, score, strict=True):
        best_of[b["path"]] = max(best_of.get(b["path"], 0), s)
    best, top = max(ratio), max(best_of.values())
    content = [r >= threshold * best for r in ratio]
    near = [best_of[b["path"]] >= threshold * top for b in found]
    before, last = [], None
    for b, c in zip(found, content, strict=True):
        before.append(last)
        last = b if c else last
    after, last = [], None
    for b, c in zip(found[::-1], content[::-1], strict=True):
        after.append(last)
        last = b if c else last
    out = []
    for b, c, close, x, y in zip(found, content, near, before, after[::-1], strict=True):
        keep = c
        if not c:
            sides = [_joins(b, z) for z in (x, y) if z]
            text, alike = b["node"].tag in _TEXT, any(w and p for w, p, _ in sides)
            # Behind or between content of a main element, a class alone sets nothing apart but labels.
            own = x is not None and any(w and main for w, _, main in sides) and (text or not _label(b["text"]))
            if y and b["node"].heading:
                keep = any(w for w, _, _ in sides)
            elif x and y:
                keep = alike or own or (text and any(w for w, _, _ in sides))
            else:
                keep = own or (close and alike)
        if keep:
            out.append(b["text"])
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row. Null html: empty text. Repeated rows give a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
