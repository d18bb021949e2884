"""Stored HTML pages as rows: cards and media tags, in Arrow batches or as table functions for SQL, and a pure SQL form for plain anchors."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser
from urllib.parse import parse_qs, unquote, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..config import DEFAULT, Settings
from ..functions.urls import accepted_media

CARD = StructType([StructField("card_ord", IntegerType()), *[StructField(n, StringType()) for n in ("key", "href", "tracking_class", "title", "thumbnail_url", "duration", "asset_id")]])
MEDIA = StructType([StructField("kind", StringType()), StructField("url", StringType())])


class _Cards(HTMLParser):
    """One card an item link. A new item link drops an open card; any link end closes it.

    One text is taken at a time: a span of either class starts it anew, and it ends as many elements
    later as were opened inside. Addresses are decoded once more than attributes are.
    """

    def __init__(self, base: str, settings: Settings):
        super().__init__(convert_charrefs=True)
        self.base, self.s, self.found, self.card = base or "", settings, [], None
        self.taking, self.depth = "", 0
        self.key_shape = re.compile(settings.key_pattern.replace(r"\z", r"\Z"))

    def _item(self, attrs: dict) -> dict | None:
        try:
            href = urljoin(self.base, unescape(attrs.get("href") or ""))
            parts = urlsplit(href)
        except ValueError:
            return None
        values = parse_qs(parts.query)
        key = (values.get(self.s.key_param) or [""])[0]
        if not parts.path.endswith(self.s.item_path) or not self.key_shape.search(key):
            return None
        return {"key": key, "href": href, "tracking_class": (values.get(self.s.class_param) or [""])[0], "title": "", "thumbnail_url": None, "duration": "", "asset_id": ""}

    def handle_starttag(self, tag, attrs):
        attrs = {k: v or "" for k, v in attrs}
        if tag == "a" and (card := self._item(attrs)):
            self.card, self.taking, self.depth = card, "", 0
            return
        if self.card is None:
            return
        if not self.card["asset_id"] and (m := re.search(self.s.overlay_pattern, attrs.get("id", ""))):
            self.card["asset_id"] = m[1]
        if tag == "img" and not self.card["thumbnail_url"]:
            self.card["thumbnail_url"] = urljoin(self.base, unescape(attrs.get("src", "")))
        classes = attrs.get("class", "").split() if tag == "span" else ()
        if begun := [name for name, wanted in (("title", self.s.title_class), ("duration", self.s.duration_class)) if wanted in classes]:
            self.taking, self.depth = begun[0], 1
        elif self.taking:
            self.depth += 1

    def handle_endtag(self, tag):
        if self.card is None:
            return
        if tag == "a":
            self.found.append(self.card | {"thumbnail_url": self.card["thumbnail_url"] or ""})
            self.card, self.taking = None, ""
        elif self.taking:
            self.depth -= 1
            if not self.depth:
                self.taking = ""

    def handle_data(self, data):
        if self.card is not None and self.taking:
            self.card[self.taking] += data


def cards_of(page: str | None, base: str | None, settings: Settings = DEFAULT) -> list[dict]:
    """All closed cards of a page in document order, texts normalised."""
    parser = _Cards(base or "", settings)
    parser.feed(page or "")
    for card in parser.found:
        for name in ("title", "duration"):
            card[name] = " ".join(unescape(card[name]).split())
    return parser.found


class _Media(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: dict[tuple[str, str], None] = {}

    def handle_starttag(self, tag, attrs):
        values = {k: unescape(v or "").strip() for k, v in attrs}
        for kind, name in (("media", "src"), ("poster", "poster")):
            if values.get(name) and (tag == "video" or tag == "source" and kind == "media"):
                self.found.setdefault((kind, values[name]))


def media_of(page: str | None) -> list[tuple[str, str]]:
    """Distinct (kind, url) of media tags; comments and scripts hold none."""
    parser = _Media()
    parser.feed(page or "")
    return list(parser.found)


def listing_cards(settings: Settings = DEFAULT):
    """Table function (html, base_url) -> cards."""

    class Cards:
        def eval(self, page: str, base: str):
            for k, c in enumerate(cards_of(page, base, settings)):
                yield (k, c["key"], c["href"], c["tracking_class"], c["title"], c["thumbnail_url"], c["duration"], c["asset_id"])

    return F.udtf(Cards, returnType=CARD)


def media_tags():
    """Table function (html) -> kind, url."""

    class Media:
        def eval(self, page: str):
            yield from media_of(page)

    return F.udtf(Media, returnType=MEDIA)


def _per_page(pages: DataFrame, keep: list[str], read: list[str], fields: StructType, rows_of) -> DataFrame:
    """(keep..., fields...) of what ``rows_of`` finds in the columns ``read`` of each page; pages go by Arrow batches."""
    kinds = [pa.int32() if isinstance(f.dataType, IntegerType) else pa.string() for f in fields]
    schema = StructType([*(pages.schema[c] for c in keep), *fields])
    names = schema.names

    def run(batches):
        for batch in batches:
            owner, found = [], []
            for k, args in enumerate(zip(*(batch.column(len(keep) + j).to_pylist() for j in range(len(read))))):
                rows = rows_of(*args)
                owner += [k] * len(rows)
                found += rows
            at = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in range(len(keep))), *(pa.array([r[j] for r in found], kind) for j, kind in enumerate(kinds))], names=names)

    return pages.select(*keep, *[F.col(c).alias(f"_{c}") for c in read]).mapInArrow(run, schema)


def scan_cards(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Cards of ``pages`` (source_idx, page, base_url, html). Pages without an item link skip the parser."""

    def rows(html: str, base: str) -> list[tuple]:
        return [(k, *(c[n] for n in CARD.names[1:])) for k, c in enumerate(cards_of(html, base, settings))]

    likely = pages.filter(F.contains("html", F.lit(settings.item_path)))
    return _per_page(likely, ["source_idx", "page", "base_url"], ["html", "base_url"], CARD, rows)


def scan_media(pages: DataFrame) -> DataFrame:
    """(page_id, kind, url) of media tags of ``pages`` (page_id, html)."""
    likely = pages.filter(F.col("html").rlike("(?i)<(source|video)"))
    return _per_page(likely, ["page_id"], ["html"], MEDIA, media_of)


ANCHOR = r'<a href="([^"]*)">([^<]*)</a>'


def plain_anchors(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., card_ord, href, title) of plain anchors, by built-ins alone."""
    hrefs = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(1))
    titles = F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(2))
    zipped = F.arrays_zip(hrefs.alias("href"), titles.alias("title"))
    return pages.select(*keep, F.posexplode(zipped).alias("card_ord", "a")).select(*keep, "card_ord", F.col("a.href").alias("href"), F.col("a.title").alias("title"))


def without_comments(html):
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def media_urls(html):
    """Absolute media addresses anywhere in the text outside comments, distinct and sorted."""
    found = F.regexp_extract_all(without_comments(html), F.lit(r"https?://[^\s\"'<>\\]+?\.(?:mp4|webm|mov|m4v|mkv)"), F.lit(0))
    return F.array_sort(F.array_distinct(found))


def player_media(pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(page_id, media, posters) of ``pages`` (page_id, html): accepted addresses of media tags in order; only where a
    page has none, accepted addresses anywhere in its text outside comments, character references decoded.

    Tags and text that a page's script holds percent-encoded in calls of ``settings.fragment_calls`` count after the
    page's own. Posters are those of all tags, accepted or not.
    """
    call = re.compile(rf"""(?:{"|".join(map(re.escape, settings.fragment_calls))})\(\s*["']([^"']+)["']""", re.IGNORECASE)
    schema = "page_id long, place int, kind string, url string"

    def run(batches):
        for batch in batches:
            rows = []
            for page, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hidden = [unquote(x) for x in call.findall(body or "")]
                tags = [(kind, unescape(u)) for part in (body, *hidden) for kind, u in media_of(part)]
                bare = _BARE.findall(unescape("\n".join([_COMMENT.sub("", body or ""), *hidden])))
                rows += [(page, k, "tag", u.rstrip(");,]")) if kind == "media" else (page, k, "poster", u.strip()) for k, (kind, u) in enumerate(tags)]
                rows += [(page, k, "text", unescape(u).rstrip(");,]")) for k, u in enumerate(bare)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string()))], names=["page_id", "place", "kind", "url"])

    found = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, schema).filter((F.col("kind") == "poster") | accepted_media(F.col("url"), settings)).filter("url <> ''")
    first = found.groupBy("page_id", "kind", "url").agg(F.min("place").alias("place"))
    listed = first.groupBy("page_id").pivot("kind", ["tag", "text", "poster"]).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]))
    return listed.select("page_id", F.when(F.size("tag") > 0, F.col("tag")).otherwise(F.col("text")).alias("media"), F.col("poster").alias("posters"))


_COMMENT = re.compile(r"<!--.*?-->", re.S)
_BARE = re.compile(r"https?://[^\"'<>\\\s]+")
