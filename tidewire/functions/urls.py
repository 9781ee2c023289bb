"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import c, let, trim_ws

# Fixed value: query parameters that only track (names, without case).
TRACKING = r"(?i)^(?:utm_.*|fbclid|gclid|igshid|mc_[ce]id|ref|ref_src|source|amp|__twitter_impression|spm|cmpid|_ga)$"
# Fixed value: what in a picture's path says that it is no photograph.
NON_PHOTO = r"(?i)logo|favicon|placeholder|avatar|sprite|no[-_]?image|default[-_](?:image|thumb)|/icons?[/.\-_]|blank\."
#: scheme, host, port, path, query of an absolute http(s) URL; user info and fragment are left out.
_HTTP = r"(?is)^(https?):/{0,2}(?:[^/?#@]*@)?([^/?#:@\s]+)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _canonical_query(q: Column) -> Column:
    """Parameters less the tracking ones, stably sorted by name, written as a form does (a blank as +)."""
    pairs = F.transform(
        F.filter(F.split(q, "&", -1), lambda p: p != ""),
        lambda p, i: F.struct(_decoded(F.regexp_replace(p, "(?s)=.*", "")).alias("k"), i.alias("i"), _decoded(F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise("")).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def normalize_url(x: Column | str) -> Column:
    """One address per article: https, lower-case host without www., no fragment, default port, user or tracking
    parameters, parameters sorted, no /amp, double or trailing slashes. Blank and non-http schemes give '', text that is no
    URL stays as it is (trimmed), null is ''."""

    def address(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, _HTTP, i)
        host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
        port = let(part(3), lambda p: F.when(p.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), p)))
        path = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(part(4), r"(?i)/amp/?\z", "/"), r"(?i)\.amp\z", ""), "/{2,}", "/"), "(?<=.)/+\\z", "")
        path = F.coalesce(F.nullif(path, F.lit("")), F.lit("/"))
        query = let(_canonical_query(part(5)), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.when(s.rlike(_HTTP), F.concat(F.lit("https://"), host, port, path, query)).when(s.rlike(_SCHEME), "").otherwise(s)

    return let(trim_ws(F.coalesce(c(x), F.lit(""))), address)


def url_hash(x: Column | str) -> Column:
    return F.sha2(F.coalesce(F.nullif(normalize_url(x), F.lit("")), trim_ws(F.coalesce(c(x), F.lit("")))), 256)


def display_host(x: Column | str) -> Column:
    """The host without www., '' where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(trim_ws(F.coalesce(c(x), F.lit(""))), _HTTP, 2)), r"^www\.", "")


def is_non_photo(x: Column | str) -> Column:
    """True for a path that names a logo, icon or placeholder, and for what is no URL."""
    s = trim_ws(F.coalesce(c(x), F.lit("")))
    return ~s.rlike(_HTTP) | F.regexp_extract(s, _HTTP, 4).rlike(NON_PHOTO)


def image_url(x: Column | str) -> Column:
    """An https picture address, or null."""
    s = trim_ws(c(x))
    ok = s.rlike(_HTTP) & F.regexp_extract(s, _HTTP, 2).contains(".") & ~is_non_photo(s)
    return F.when(ok, F.regexp_replace(s, "(?i)^http:", "https:"))


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments worked off."""
    none = F.array().cast("array<string>")
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))
    # the first segment is the empty one before the leading slash and stays
    kept = lambda parts: F.aggregate(parts, none, lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    whole = let(F.split(path, "/", -1), lambda parts: F.concat(F.array_join(kept(parts), "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise("")))
    return F.when(path.rlike(r"(?:^|/)\.{1,2}(?:/|\z)"), whole).otherwise(path)


def resolve_url(raw: Column | str, base: Column | str) -> Column:
    """raw against base: absolute as it is; //host, /path, relative paths, ?query and #fragment resolved; '' where that fails."""
    r, b = trim_ws(F.coalesce(c(raw), F.lit(""))), trim_ws(F.coalesce(c(base), F.lit("")))
    part = lambda n: F.regexp_extract(b, r"(?i)^(https?://[^/?#]+)([^?#]*)(\?[^#]*)?", n)
    origin, path = part(1), F.coalesce(F.nullif(part(2), F.lit("")), F.lit("/"))
    own, rest = F.regexp_extract(r, r"(?s)^([^?#]*)(.*)", 1), F.regexp_extract(r, r"(?s)^([^?#]*)(.*)", 2)
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    return (
        F.when(r == "", "").when(r.rlike(r"(?i)^https?://"), r).when(r.startswith("//"), F.concat(F.lit("https:"), r)).when(r.rlike(_SCHEME) | (origin == ""), "")
        .when(r.startswith("?"), F.concat(origin, path, r)).when(r.startswith("#"), F.concat(origin, path, part(3), r))
        .otherwise(F.concat(origin, _without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), rest))
    )
