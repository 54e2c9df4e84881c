"""URL columns. Nothing here raises on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visit (fixed value).
TRACKING = r"(utm_[^=&]*|fbclid[^=&]*|gclid[^=&]*|mc_[^=&]*)(=[^&]*)?"


def site_of(url: Column) -> Column:
    """Host in lower case without a leading ``www.`` and without a port; '' where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.coalesce(host, F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def origin_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(url)), r"^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)


def path_of(url: Column) -> Column:
    """Path, '/' if empty."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def url_norm(url: Column) -> Column:
    """Without fragment and without a trailing slash, unless the path is only that."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/$"), bare).otherwise(F.regexp_replace(bare, r"/$", ""))


def url_canon(url: Column) -> Column:
    """``url_norm`` without tracking parameters; scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    no = F.regexp_replace(bare, r"([?&])" + TRACKING + r"(?=&|$)", "$1")
    no = F.regexp_replace(F.regexp_replace(F.regexp_replace(no, r"&{2,}", "&"), r"\?&+", "?"), r"[?&]+$", "")
    start = F.regexp_extract(no, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    no = F.concat(F.lower(start), F.substring(no, F.length(start) + 1, F.lit(1_000_000)))
    return F.when(no.rlike(r"^[a-z][a-z0-9+.-]*://[^/?#]+/$"), no).otherwise(F.regexp_replace(no, r"/$", ""))


def same_site(a: Column, b: Column, subdomains: bool = False) -> Column:
    """Equal hosts, or equal last two labels."""
    if not subdomains:
        return site_of(a) == site_of(b)
    last = lambda u: F.slice(F.split(site_of(u), r"\."), -2, 2)
    return (F.size(F.split(site_of(a), r"\.")) >= 2) & (F.size(F.split(site_of(b), r"\.")) >= 2) & (last(a) == last(b))


def slug_words(url: Column) -> Column:
    return F.regexp_replace(path_of(url), r"[-_/]", " ")


def robots_regex(pattern: Column) -> Column:
    """A robots.txt path pattern as a regular expression: * any run, $ at the end the end, else a prefix."""
    quoted = F.regexp_replace(pattern, r"([.+?^{}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", ".*"), r"\$(?!$)", r"\\$"))
