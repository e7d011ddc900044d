"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import text_of

# Fixed value: query keys that only track.
TRACKING = "^(utm_|fbclid|gclid|ref$|ref_|cmpid|ncid|sr_share)"
SCHEME = "(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?"


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, f"^{SCHEME}//([^/?#]*)", 1))


def without_www(host: Column) -> Column:
    return F.regexp_replace(host, "^www\\.", "")


def domain_of(url: str | Column) -> Column:
    """Host in lower case without port and leading www."""
    return without_www(F.substring_index(netloc(text_of(url)), ":", 1))


def _decoded(part: Column) -> Column:
    """Form decoding; a percent sign without two digits stays."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25")), part)


def _encoded(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(url: str | Column) -> Column:
    """https, no www., no final slash, no fragment or parameters, no tracking or blank query keys."""
    u = F.trim(text_of(url))
    path = F.regexp_extract(u, f"^{SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "/+$", "")
    path = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    pairs = F.transform(
        F.split(F.regexp_extract(u, "^[^?#]*\\?([^#]*)", 1), "&"),
        lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.regexp_extract(p, "=(.*)$", 1)).alias("v")),
    )
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].rlike(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.concat(F.lit("https://"), without_www(netloc(u)), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def unquoted(text: Column) -> Column:
    """Percent decoding that leaves + alone."""
    return _decoded(F.replace(text, F.lit("+"), F.lit("%2B")))


def domain_suffixes(domain: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: equality with one of them is a match of the domain or a parent."""
    parts = F.split(domain, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
