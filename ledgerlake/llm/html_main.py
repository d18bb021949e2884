"""Main text of a page by the distribution of its line blocks.

Markup is stripped so that each block of the page becomes one line. Lines of scripts, styles,
menus, headers, footers, sidebars, notices, adverts, forms and reader comments carry no text.
An element with the class or id of such a part is kept all the same if it holds a marked article,
and so is any other such element where the page has no marked text without it.
Where a page marks its article (``article``, ``main``, ``role=main``, ``itemprop=articleBody``),
lines outside it are blank, and so is a whole window of lines in it that are mostly made of links;
elsewhere every such line is. The text lengths are then summed over sliding windows of lines: a sum
that rises over the threshold is a surge, one that falls to it again is a dive. The text between a
surge and its dive is kept for every stretch in page order; where several articles are marked, for
those in the one that has the stretch with the most text.

Inside a marked article the threshold is zero, so short paragraphs and headings stay. Elsewhere a
stretch needs windows of more than ``SURGE`` characters; a page without any such window keeps all
its lines, as it is a short one. The surge and dive lines of a page are those of the first and the
last stretch kept.

White space inside a block becomes one space; a line break element counts as white space;
character references are decoded once. Null, empty and text-less pages give an empty text.
Repeated rows are treated one by one; columns other than ``page_id``, ``url`` and ``html`` are
not read. Texts and pages are never cut.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

WINDOW = 3
SURGE = 80

# Element names by role.
_RAW = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "title")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav aside footer form head select button dialog menu fieldset".split())
# Elements that a following block start ends by itself.
_LOOSE = frozenset("p li dt dd tr td th option".split())
# Names of what surrounds a text. A class or id is noise if it is made of them, places and shapes aside
# (site-footer, comments-list); with any other word beside it, it names what a text is about (copyright-law, post-share).
_WORDS = r"ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|sidebar|menus?|navbar|navigation|nav|breadcrumbs?|footer|masthead|topbar|cookies?|consent|notices?|alerts?|popup|modal|comments?|commentlist|disqus|replies|reply|respond|share|sharing|social|related|newsletter|subscribe|toolbar|pagination|pager|copyright|disclaimer|signup|login|widgets?"
# Parts whose articles are others' than the page's.
_OTHER_WORDS = r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|comments?|commentlist|disqus|replies|reply|respond|related"
_PLACES = r"areas?|bar|blocks?|body|bottom|box|boxes|buttons?|columns?|container|content|cookie|count|desktop|form|global|group|header|holder|icons?|inner|items?|left|links?|lists?|main|mobile|my|outer|page|panel|posts|primary|right|row|secondary|section|site|slot|sticky|top|unit|wrap|wrapper|zone|\d*"
_NOISE, _OTHERS, _AROUND = (re.compile(w) for w in (_WORDS, _OTHER_WORDS, f"{_WORDS}|{_PLACES}"))
_WHOLE = frozenset(("side-bar", "skip-link"))
# Inside a tag, a "<" outside quotes starts the next one: so no tag is looked at twice. Drawings and formulas may close
# themselves.
_INSIDE = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({'|'.join(_RAW)})\b(?!(?<=svg){_INSIDE}(?<=/)>|(?<=math){_INSIDE}(?<=/)>){_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})>|<[!?][^<>]*>",
    re.S | re.I,
)
_MARK = re.compile(r"<(?:article|main)\b|\brole\s*=\s*[\"']?main\b|\bitemprop\s*=\s*[\"']?articlebody\b", re.I)
_ATTR = re.compile(r"([a-zA-Z:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def lines_of(page: str, spare: int = 0) -> list[tuple[str, int, bool]]:
    """The page's blocks in order: text, characters inside links, whether inside a marked article.
    ``spare``: which elements that hold a marked article are kept. 0: those with a noisy class or id;
    1: also forms, menus and hidden ones; 2: also comments and the like."""
    out: list[tuple[str, int, bool]] = []
    text: list[str] = []
    linked = links = 0
    inside: list[str] = []  # open marked articles
    dropped: list[list] = []  # the open dropped element: [name, depth of that name]
    depth: list[list] = []  # open elements that mark articles: [name, depth]

    def end_line(closing: bool = False):
        """A line ends at each block border; an element that closes without text leaves a blank one."""
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if joined:
            out.append((joined, min(linked, len(joined)), bool(inside)))
        elif closing:
            out.append(("", 0, bool(inside)))
        linked = 0

    def take(part: str):
        nonlocal linked
        if not dropped and part:
            text.append(part)
            if links:
                linked += len(part)

    def drops(name: str, raw: str, begin: int) -> bool:
        if name not in _DROPPED and (name != "header" or inside) and not (raw and _is_noise(name, raw, bool(inside))):
            return False
        if name == "article" or "article" in inside:
            return True
        if name in _LOOSE or not has_mark:  # a loose element ends where an article starts
            return True
        if spare < 1 and (name in _DROPPED or name == "header" or _is_hidden(raw)) or spare < 2 and _named(raw, _OTHERS):
            return True
        if not articles:
            articles.append(_Articles(page))
        return not articles[0].inside(begin)

    has_mark = bool(_MARK.search(page))
    articles: list[_Articles] = []  # found when first asked for
    at = 0
    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = bool(m[2])
        if name in ("br", "wbr"):
            take(" " if name == "br" else "")
            continue
        if name == "a":
            links = max(0, links - 1) if closing else links + 1
        if name not in _BLOCKS and not dropped and name != "button":
            if not closing and name not in _VOID and m[4] and drops(name, m[4], at):
                dropped.append([name, 1])
            continue
        if dropped:
            top = dropped[0]
            if top[0] in _LOOSE and not closing and name in _BLOCKS and name != "br":
                dropped.clear()
            elif name == top[0]:
                top[1] += -1 if closing else 1
                if top[1] <= 0:
                    dropped.clear()
                    if name in _BLOCKS:
                        text.clear()
                continue
            else:
                continue
        end_line(closing)
        links = 0
        if closing:
            if depth and depth[-1][0] == name:
                depth[-1][1] -= 1
                if not depth[-1][1]:
                    depth.pop()
                    inside.pop()
            continue
        if name in _VOID:
            continue
        if drops(name, m[4] or "", at):
            dropped.append([name, 1])
            continue
        if name in ("article", "main") or m[4] and _marks_article(m[4]):
            depth.append([name, 1])
            inside.append(name)
        elif depth and depth[-1][0] == name:
            depth[-1][1] += 1
    take(page[at:] if not dropped else "")
    end_line()
    return out


def _attrs(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(raw)}


def _noisy(value: str, words: re.Pattern) -> bool:
    """Whether one of the names of a class or id has one of the words and none but them, places and shapes."""
    for name in value.lower().split():
        parts = re.split("[-_]+", name)
        if name in _WHOLE and words is _NOISE or any(map(words.fullmatch, parts)) and all(map(_AROUND.fullmatch, parts)):
            return True
    return False


def _named(raw: str, words: re.Pattern) -> bool:
    found = _attrs(raw)
    return any(_noisy(found.get(k, ""), words) for k in ("class", "id"))


def _is_hidden(raw: str) -> bool:
    found = _attrs(raw)
    return found.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog") or "hidden" in raw.split() or found.get("aria-hidden") == "true"


def _is_noise(name: str, raw: str, inside: bool) -> bool:
    if name in ("html", "body", "main", "article"):
        found = _attrs(raw)
        return name == "article" and _noisy(found.get("class", ""), _NOISE) and inside
    return _is_hidden(raw) or _named(raw, _NOISE)


class _Articles:
    """Where a page's marked articles that are no noise themselves begin, and where its elements end: one pass."""

    def __init__(self, page: str):
        self.begins: list[int] = []
        self.ends: dict[int, int] = {}  # from behind a start tag to its end tag, by depth of that name
        opened: dict[str, list[int]] = {}
        for m in _TOKEN.finditer(page):
            name = (m[3] or "").lower()
            if not name:
                continue
            if m[2]:
                if opened.get(name):
                    self.ends[opened[name].pop()] = m.start()
                continue
            if name == "main" or name == "article" and not _named(m[4] or "", _NOISE) or m[4] and _marks_article(m[4]):
                self.begins.append(m.start())
            opened.setdefault(name, []).append(m.end())

    def inside(self, begin: int) -> bool:
        """Whether the element whose content starts at ``begin`` holds one."""
        k = bisect_left(self.begins, begin)
        return k < len(self.begins) and self.begins[k] < self.ends.get(begin, self.begins[k] + 1)


def _marks_article(raw: str) -> bool:
    found = _attrs(raw)
    return found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody"


def stretches(sizes: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges between each surge and its dive. ``sizes``: text lengths of the lines."""
    sums, total = [], sum(sizes[:window])
    for k in range(len(sizes)):
        sums.append(total)
        total += (sizes[k + window] if k + window < len(sizes) else 0) - sizes[k]
    out, start = [], None
    for k, s in enumerate(sums):
        if start is None and s > threshold and sizes[k]:
            start = k  # surge
        elif start is not None and (s <= threshold and not sizes[k] or s == 0):
            out.append((start, k))  # dive
            start = None
    if start is not None:
        out.append((start, len(sizes)))
    return out


def link_runs(lines: list[tuple[str, int, bool]], marked: bool) -> list[bool]:
    """Lines that are menus: mostly made of links; inside a marked article only where a whole window of them follows
    one another, blank lines aside."""
    linked = [2 * n > len(t) for t, n, _ in lines]
    if not marked:
        return linked
    out, run = [False] * len(lines), []
    for k, (text, _, _) in enumerate([*lines, ("x", 0, False)]):
        if k < len(lines) and linked[k]:
            run.append(k)
        elif text:
            for x in run if len(run) >= WINDOW else ():
                out[x] = True
            run = []
    return out


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text, and the first and end line of the stretches that it was taken from."""
    if not page:
        return "", 0, 0
    lines = lines_of(page)
    marked = any(x[2] and x[0] for x in lines)
    if not marked and _MARK.search(page):
        for spare in (1, 2):
            found = lines_of(page, spare)
            if any(x[2] and x[0] for x in found):
                lines, marked = found, True
                break
    sizes = [0 if menu or marked and not inside else len(t) for (t, _, inside), menu in zip(lines, link_runs(lines, marked))]
    found = stretches(sizes, 0 if marked else SURGE) or stretches(sizes, 0)
    if not found:
        return "", 0, 0
    if not marked:
        return "\n".join(lines[k][0] for r in found for k in range(*r) if sizes[k]), found[0][0], found[-1][1]
    start, end = max(found, key=lambda r: (sum(sizes[r[0] : r[1]]), -r[0]))
    # blank lines inside one article don't part it
    first = next(k for k in range(len(lines)) if sizes[k])
    joined = [r for r in found if all(x[2] for x in lines[min(r[0], start) : max(r[1], end)])]
    start, end = min([start, *(r[0] for r in joined)]), max([end, *(r[1] for r in joined)])
    start = max(start, first)
    return "\n".join(lines[k][0] for k in range(start, end) if sizes[k]), start, end


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, surge_line, dive_line) for every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [main_text(x) for x in batch.column(2).to_pylist()]
            texts = [r[0] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
                names=["page_id", "url", "text", "n_chars", "surge_line", "dive_line"],
            )

    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return kept.mapInArrow(run, "page_id long, url string, text string, n_chars long, surge_line long, dive_line long")
