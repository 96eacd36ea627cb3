"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def strip_slash(url: Column) -> Column:
    """Without trailing slashes."""
    return F.rtrim(url, F.lit("/"))


def match_key(url: Column) -> Column:
    """Without trailing slashes, lower case."""
    return F.lower(strip_slash(url))


def _plain(url: Column) -> Column:
    """Without query and fragment."""
    return F.substring_index(F.substring_index(url, "#", 1), "?", 1)


def _head(plain: Column) -> Column:
    """Scheme and host of an absolute URL; plain text functions, as URLs are taken apart for every link."""
    return F.substring_index(plain, "/", 3)


def _absolute(plain: Column) -> Column:
    return F.contains(plain, F.lit("://"))


def host(url: Column) -> Column:
    plain = _plain(url)
    return F.when(_absolute(plain), F.lower(F.substring_index(_head(plain), "/", -1))).otherwise("")


def path(url: Column) -> Column:
    plain = _plain(url)
    return F.when(_absolute(plain), F.substr(plain, F.length(_head(plain)) + 1)).otherwise(plain)


def query(url: Column) -> Column:
    kept = F.substring_index(url, "#", 1)
    return F.substr(kept, F.length(F.substring_index(kept, "?", 1)) + 2)


def scheme(url: Column) -> Column:
    plain = _plain(url)
    return F.when(_absolute(plain), F.lower(F.substring_index(plain, "://", 1))).otherwise("")


def node_key(url: Column) -> Column:
    """Graph node: scheme, lower-case host and path, without query, fragment and trailing slashes."""
    plain = _plain(url)
    head = _head(plain)
    rest = strip_slash(F.substr(plain, F.length(head) + 1))
    return F.concat(F.lower(head), F.when(rest == "", "/").otherwise(rest))


def root(url: Column) -> Column:
    """Homepage of the site that holds the URL."""
    return F.concat(scheme(url), F.lit("://"), host(url))


def bare_host(raw: Column) -> Column:
    """Host name without scheme, port and leading ``www.``; accepts bare domains."""
    text = F.lower(F.trim(raw))
    full = F.when(F.rlike(text, F.lit("^https?://")), text).otherwise(F.concat(F.lit("https://"), text))
    return F.regexp_replace(F.regexp_replace(host(full), r"^[^@]*@|:\d+$", ""), r"^www\.", "")


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def depth(url: Column) -> Column:
    return F.size(segments(url))


def silo(url: Column) -> Column:
    """First path segment."""
    return F.coalesce(F.get(segments(url), F.lit(0)), F.lit("(root)"))


def param_count(url: Column) -> Column:
    """Distinct query parameters that have a value."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.rlike(p, F.lit("^[^=]*=.+")))
    return F.size(F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1))))


def is_homepage(url: Column) -> Column:
    return strip_slash(path(url)) == ""


def same_site(result_host: Column, domain: Column) -> Column:
    """Host equal to the domain or one of its subdomains."""
    return (result_host == domain) | F.endswith(result_host, F.concat(F.lit("."), domain))
