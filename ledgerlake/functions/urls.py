"""URL functions. Everything is built on lenient built-ins; joining follows the standard resolver."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..config import DEFAULT, Settings
from .text import first_present, present


@pandas_udf(StringType())
def url_join(base: pd.Series, link: pd.Series) -> pd.Series:
    """A link against its page, as browsers resolve it; a bad link gives an empty string."""

    def one(b, x):
        try:
            return urljoin(b or "", x or "")
        except ValueError:
            return ""

    return pd.Series([one(b, x) for b, x in zip(base, link)], index=base.index, dtype=object)


def host(url: Column) -> Column:
    """Lower-case host without user, port and trailing dots; blank if there is none."""
    return F.regexp_replace(F.lower(F.coalesce(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1), F.lit(""))), r"\.+\z", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)


def pairs(url: Column) -> Column:
    """The query's ``name=value`` parts in order, without empty ones."""
    return F.filter(F.split(query(url), "&"), lambda p: p != "")


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def query_value(url: Column, name: str) -> Column:
    """First value of a query parameter that is not blank, decoded; blank if there is none."""
    named = F.filter(pairs(url), lambda p: (_decoded(F.substring_index(p, "=", 1)) == name) & F.contains(p, F.lit("=")))
    values = F.filter(F.transform(named, lambda p: _decoded(F.regexp_extract(p, r"\A[^=]*=(.*)\z", 1))), lambda v: v != "")
    return F.coalesce(F.get(values, F.lit(0)), F.lit(""))


def page_url(url: Column, page: Column, settings: Settings = DEFAULT) -> Column:
    """The listing's URL for a page: any page parameter is replaced by one at the end, the fragment goes."""
    kept = F.filter(pairs(url), lambda p: F.lower(_decoded(F.substring_index(p, "=", 1))) != settings.page_param)
    parts = F.concat(kept, F.array(F.concat(F.lit(settings.page_param + "="), page.cast("string"))))
    return F.concat(F.regexp_extract(url, r"\A[^?#]*", 0), F.lit("?"), F.array_join(parts, "&"))


def canonical_url(base: Column, key: Column, settings: Settings = DEFAULT) -> Column:
    """The item's own URL on the base's host, with its key alone."""
    origin = F.regexp_extract(base, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return F.concat(origin, F.lit(f"{settings.item_path}?{settings.key_param}="), F.url_encode(key))


def normalized_source(url: Column) -> Column:
    """Identity of a source: https, lower-case host without port, sorted query, no fragment."""
    sorted_query = F.array_join(F.array_sort(pairs(url)), "&")
    place = F.when(path(url) == "", F.lit("/")).otherwise(path(url))
    return F.concat(F.lit("https://"), host(url), place, F.when(sorted_query != "", F.concat(F.lit("?"), sorted_query)).otherwise(F.lit("")))


def source_name(name: Column, url: Column, default: str = "source") -> Column:
    """Given name, else the category or next parameter of the URL, else the default; 40 characters at most."""
    return F.substring(first_present(F.trim(F.coalesce(name, F.lit(""))), query_value(url, "category"), query_value(url, "next"), F.lit(default)), 1, 40)


def asset_id(url: Column) -> Column:
    """Stem of the last path part if it is all digits, else blank."""
    return F.coalesce(F.regexp_extract(path(url), r"(?:\A|/)(\d+)(?:\.[^./]+)?/*\z", 1), F.lit(""))


def overlay_id(element_id: Column, settings: Settings = DEFAULT) -> Column:
    return F.coalesce(F.regexp_extract(element_id, settings.overlay_pattern, 1), F.lit(""))


def extension(name: Column) -> Column:
    """Lower-case extension of a path's last part, blank if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(path(name), r"[^/.][^/]*\.([A-Za-z0-9]+)\z", 1), F.lit("")))


def media_extension(url: Column, settings: Settings = DEFAULT) -> Column:
    ext = extension(url)
    return F.when(ext.isin(*settings.media_extensions), ext).otherwise(F.lit(settings.default_extension))


def extension_label(name: Column) -> Column:
    return F.coalesce(present(F.upper(extension(name))), F.lit("OTHER"))


def public_host(name: Column) -> Column:
    """False for blank, local and private hosts and for loopback, private and link-local addresses."""
    v4 = name.rlike(r"\A\d{1,3}(\.\d{1,3}){3}\z")
    private = name.rlike(r"\A(0|10|127)\.|\A169\.254\.|\A192\.168\.|\A172\.(1[6-9]|2\d|3[01])\.|\A(22[4-9]|2[3-5]\d)\.|\A100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.")
    local = name.isin("", "localhost") | name.rlike(r"\.(local|internal|localhost)\z") | (~v4 & ~F.contains(name, F.lit("."))) | F.contains(name, F.lit("["))
    return ~F.coalesce(local | (v4 & private), F.lit(True))


def accepted_media(url: Column, settings: Settings = DEFAULT) -> Column:
    return F.lower(url).startswith("https://") & extension(url).isin(*settings.media_extensions) & public_host(host(url))


def media_score(url: Column, settings: Settings = DEFAULT) -> Column:
    """What makes an address the better one: how many signature parameters it has, then a playable extension."""
    names = F.array_distinct(F.transform(pairs(url), lambda p: F.lower(_decoded(F.substring_index(p, "=", 1)))))
    signed = F.size(F.array_intersect(names, F.array(*[F.lit(k) for k in settings.signature_keys])))
    return F.struct(signed.alias("signed"), extension(url).isin(*settings.playable_extensions).cast("int").alias("playable"))


def choose_media(urls: Column, settings: Settings = DEFAULT) -> Column:
    """The first of the best addresses of an array; blank for none."""
    ranked = F.transform(urls, lambda u, i: F.struct(media_score(u, settings).alias("score"), (-i).alias("place"), u.alias("url")))
    return F.coalesce(F.array_max(ranked)["url"], F.lit(""))


def listing_problem(url: Column, settings: Settings = DEFAULT) -> Column:
    """Why a listing URL is out of scope, null if it is in scope."""
    return (
        F.when(url.isNull() | ~F.lower(url).startswith("https://"), F.lit("scheme"))
        .when(F.regexp_extract(url, r"\A[^/]*//([^/?#]*)", 1).contains("@"), F.lit("userinfo"))
        .when(~host(url).isin(*settings.hosts), F.lit("host"))
        .when(~path(url).isin(*settings.listing_paths), F.lit("path"))
    )
