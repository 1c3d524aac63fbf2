"""URL expressions: hosts, tracking parameters, canonical forms and job-system fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall import vocabulary as v
from rolecall.functions.text import once

_PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))


def host_of(url: Column) -> Column:
    """Host in lower case without port, user and ``www.``."""
    host = F.regexp_replace(F.regexp_replace(_part(url, 2), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def _decoded(text: Column) -> Column:
    """Percent escapes and plus signs resolved; a percent sign without two hex digits stands for itself."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def _kept(url: Column, tracking: str) -> Column:
    """Decoded query pairs with a value, ``struct(k, pair)``, without tracking ones."""
    pairs = F.filter(F.split(_part(url, 4), "&"), lambda p: p.rlike("(?s)^[^=]*=."))
    named = F.transform(pairs, lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_replace(p, "(?s)^[^=]*=", "")).alias("v")))
    return F.transform(F.filter(named, lambda x: ~x["k"].rlike(tracking)), lambda x: F.struct(x["k"].alias("k"), F.concat(x["k"], F.lit("="), x["v"]).alias("pair")))


def strip_tracking(url: Column) -> Column:
    """The URL without tracking parameters, fragment and end slashes; other parameters decoded, those of one name together where it first stands."""
    kept = _kept(url, v.TRACKING)
    names = F.transform(kept, lambda x: x["k"])
    placed = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.array_position(names, x["k"]).alias("first"), i.alias("i"), x["pair"].alias("pair"))))
    query = F.array_join(F.transform(placed, lambda x: x["pair"]), "&")
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    return F.concat(
        F.lower(_part(url, 1)), F.lit("://"), F.lower(_part(url, 2)), F.when(path == "", "/").otherwise(path),
        F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)),
    )


def canonical_url(url: Column) -> Column:
    """What dedupe compares: no ``www.``, decoded and sorted parameters, the wider tracking list; empty without a URL."""
    kept = F.array_join(F.array_sort(F.transform(_kept(url, v.DEDUPE_TRACKING), lambda x: x["pair"])), "&")
    port = F.regexp_extract(_part(url, 2), "(:[0-9]+)$", 1)
    made = F.concat(
        F.lower(_part(url, 1)), F.lit("://"), host_of(url), port, F.regexp_replace(_part(url, 3), "/+$", ""),
        once(kept, lambda query: F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))),
    )
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(made)


def is_aggregator(url: Column) -> Column:
    host = host_of(url)
    fits = F.lit(False)
    for name in v.AGGREGATOR_HOSTS:
        fits = fits | (host == name) | host.endswith("." + name)
    return fits


def detect_ats(text: Column) -> Column:
    """The first job system whose signature is in the text; null if none."""
    found = None
    for name, pattern in v.ATS_SIGNATURES:
        found = F.when(text.rlike(pattern), name) if found is None else found.when(text.rlike(pattern), name)
    return found


def canonical_apply_url(url: Column, description: Column) -> Column:
    """A direct URL cleaned; for an aggregator's, the best URL of the description (job system 2, careers word 1), first of equals."""
    links = F.regexp_extract_all(F.coalesce(description, F.lit("")), F.lit(r"https?://[^\s<>\"'\)\]]+"), F.lit(0))
    rank = lambda u: F.when(is_aggregator(u), 0).when(detect_ats(u).isNotNull(), 2).when(F.lower(u).rlike("careers|jobs|apply|join"), 1).otherwise(0)
    ranked = F.transform(links, lambda u, i: F.struct((-rank(u)).alias("r"), i.alias("i"), u.alias("u")))
    best = F.array_min(F.filter(ranked, lambda x: x["r"] < 0))["u"]
    return F.when(~is_aggregator(url), strip_tracking(url)).when(best.isNotNull(), strip_tracking(best))


_REFERENCE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def _without_dots(segments: Column) -> Column:
    """The path of these segments, the first being empty, with ``.`` and ``..`` resolved; no step leads above the root."""
    none = F.array(F.lit(""))
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.greatest(F.size(segments) - 1, F.lit(0))), none,
        lambda kept, s: F.when(s == ".", kept).when(s != "..", F.array_append(kept, s)).when(F.size(kept) > 1, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(kept),
    )
    return F.array_join(F.when(F.element_at(segments, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolve(base: Column, reference: Column) -> Column:
    """The URL that ``reference`` means on the page ``base``, by RFC 3986: absolute, by scheme, by root, relative with steps up, query or fragment alone.

    A relative path's empty inner segments are dropped, as browsers' libraries do. A
    null stays null; a ``base`` without scheme and host gives the reference itself.
    """
    part = lambda url, k: F.regexp_extract(url, _REFERENCE, k)
    scheme, host, path, query, fragment = (part(reference, k) for k in range(1, 6))
    root = F.concat(F.lower(part(base, 1)), F.lit("://"), part(base, 2))
    above = F.split(F.regexp_replace(part(base, 3), "[^/]*$", ""), "/")
    joined = F.split(F.concat(F.when(F.array_join(above, "/") == "", "/").otherwise(F.array_join(above, "/")), path), "/")
    inner = F.filter(F.slice(joined, F.lit(2), F.greatest(F.size(joined) - 2, F.lit(0))), lambda s: s != "")
    merged = F.concat(F.array(F.lit("")), inner, F.array(F.element_at(joined, -1)))
    tail = F.concat(query, fragment)
    found = (
        F.when((scheme != "") & (host == ""), reference)
        .when(host != "", F.concat(F.coalesce(F.nullif(F.lower(scheme), F.lit("")), F.lower(part(base, 1))), F.lit("://"), host, F.when(path != "", _without_dots(F.split(path, "/"))).otherwise(""), tail))
        .when(path.startswith("/"), F.concat(root, _without_dots(F.split(path, "/")), tail)).when(path != "", F.concat(root, _without_dots(merged), tail))
        .when(query != "", F.concat(root, part(base, 3), tail)).when(fragment != "", F.concat(root, part(base, 3), part(base, 4), fragment)).otherwise(base)
    )
    return F.when(reference.isNotNull(), F.when((part(base, 1) != "") & (part(base, 2) != ""), found).otherwise(reference))


def site_of(url: Column) -> Column:
    """What stands between ``//`` and the path, in lower case, without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _REFERENCE, 2)), r"^www\.", "")
