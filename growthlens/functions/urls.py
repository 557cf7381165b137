"""URL identity as Column expressions.

One split pattern (scheme, authority, path, query, fragment) feeds every key. It never
raises on malformed input, which the built-in URL parser does under ANSI mode.
Four different identities exist on purpose; none of them is "the" normal form:

* ``url_key``       page identity: no fragment, no port, no ``www.``, no trailing slash
* ``exact_url``     fetch identity: keeps ``www.``, the trailing slash and a non-default port
* ``slash_key``     canonical comparison: keeps ``www.``, drops the trailing slash
* ``issue_url_key`` week-over-week identity: like ``url_key`` but keeps the fragment
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of an absolute URL and the whitespace a URL is trimmed of.
URL_PATTERN = r"^([a-zA-Z][a-zA-Z0-9_+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
BLANKS = " \t\n\r\f\x0b"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_blanks(col) -> Column:
    return F.btrim(_c(col), F.lit(BLANKS))


def bare_host(host) -> Column:
    """Lower case, no trailing dots, no leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.lower(_c(host)), r"\.+$", ""), r"^www\.", "")


def url_scheme(url) -> Column:
    return F.lower(F.regexp_extract(strip_blanks(url), URL_PATTERN, 1))


def url_host(url) -> Column:
    """Lower-case host without user info and port; empty when there is none."""
    authority = F.regexp_extract(strip_blanks(url), URL_PATTERN, 2)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))


def url_port(url) -> Column:
    authority = F.regexp_extract(strip_blanks(url), URL_PATTERN, 2)
    return F.nullif(F.regexp_extract(authority, r":(\d+)$", 1), F.lit(""))


def url_path(url) -> Column:
    """Path without ``;params`` of the last segment; empty path becomes ``/``."""
    path = F.regexp_replace(F.regexp_extract(strip_blanks(url), URL_PATTERN, 3), r";[^/]*$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_query(url) -> Column:
    """Query with its leading ``?``; a lone ``?`` counts as no query."""
    q = F.regexp_extract(strip_blanks(url), URL_PATTERN, 4)
    return F.when(q == "?", F.lit("")).otherwise(q)


def url_fragment(url) -> Column:
    f = F.regexp_extract(strip_blanks(url), URL_PATTERN, 5)
    return F.when(f == "#", F.lit("")).otherwise(f)


def drop_fragment(url) -> Column:
    return F.regexp_replace(strip_blanks(url), r"#.*$", "")


# Pieces of an absolute URL. The head is scheme plus authority.
_HEAD = r"^[a-zA-Z][a-zA-Z0-9_+.-]*://[^/?#]+"
_TAIL = r"^[a-zA-Z][a-zA-Z0-9_+.-]*://[^/?#]*"


def _identity(url, host_rule: str, keep_slash: bool, keep_fragment: bool) -> Column:
    """Head rewritten by one rule, path without params, query, optionally the fragment."""
    u = strip_blanks(url)
    head = F.regexp_extract(u, _HEAD, 0)
    path = F.regexp_replace(
        F.regexp_extract(u, _TAIL + r"([^?#]*)", 1), r";[^/]*$" if keep_slash else r"/*(?:;[^/]*)?$", ""
    )
    query = F.regexp_extract(u, _TAIL + r"[^?#]*(\?[^#]+)", 1)
    pieces = [F.regexp_replace(F.lower(head), host_rule, "$1$2"), F.when(path == "", "/").otherwise(path), query]
    if keep_fragment:
        pieces.append(F.regexp_extract(u, _TAIL + r"[^#]*(#.+)$", 1))
    return F.when(head != "", F.concat(*pieces)).otherwise(u if keep_fragment else drop_fragment(url))


_BARE = r"^([^:]+://)(?:[^@]*@)?(?:www\.)?(.*?)\.*(?::\d*)?$"
_FULL = r"^([^:]+://)(?:[^@]*@)?(.*?)(?::\d*)?$"
_PORT = r"^([^:]+://)(?:[^@]*@)?(.*?)(?:(?<=^http://.{0,300}):80|(?<=^https://.{0,300}):443|:)?$"


def url_key(url) -> Column:
    return _identity(url, _BARE, keep_slash=False, keep_fragment=False)


def exact_url(url) -> Column:
    return _identity(url, _PORT, keep_slash=True, keep_fragment=False)


def slash_key(url) -> Column:
    return _identity(url, _FULL, keep_slash=False, keep_fragment=False)


def issue_url_key(url) -> Column:
    return _identity(url, _BARE, keep_slash=False, keep_fragment=True)


def same_site(url, site) -> Column:
    host = bare_host(url_host(url))
    return (host != "") & (host == bare_host(url_host(site)))


def host_in(host, domains: Column) -> Column:
    """True when the host equals one of ``domains`` (array) or is a subdomain of it."""
    h = F.regexp_replace(F.lower(_c(host)), r"\.+$", "")
    return F.coalesce(
        F.exists(domains, lambda d: (h == bare_host(d)) | h.endswith(F.concat(F.lit("."), bare_host(d)))),
        F.lit(False),
    )


def skip_url(url, parts: Column) -> Column:
    u = _c(url)
    return F.coalesce(F.exists(parts, lambda p: (p != "") & F.contains(u, p)), F.lit(False))


def on_exact_host(url, site) -> Column:
    """Host equality without folding ``www.`` (URL submission rule)."""
    with_scheme = F.when(F.contains(_c(site), F.lit("://")), _c(site)).otherwise(F.concat(F.lit("https://"), _c(site)))
    site_host = F.regexp_replace(url_host(with_scheme), r"\.+$", "")
    return (site_host != "") & (F.regexp_replace(url_host(url), r"\.+$", "") == site_host)


def _fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.regexp_replace(path, r"^/", ""), "/")
    last = F.element_at(segments, -1)
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == ".", acc)
        .when(seg == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.array_append(acc, seg)),
    )
    tail = F.when(last.isin(".", "..") & (F.size(folded) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.concat(F.lit("/"), F.array_join(folded, "/"), tail)


def join_url(base, href) -> Column:
    """RFC 3986 reference resolution with built-in expressions only."""
    b, h = strip_blanks(base), strip_blanks(href)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    base_path = F.regexp_extract(b, URL_PATTERN, 3)
    base_dir = F.regexp_replace(F.when(base_path == "", F.lit("/")).otherwise(base_path), r"[^/]*$", "")
    h_path = F.regexp_extract(h, r"^([^?#]*)", 1)
    h_rest = F.regexp_extract(h, r"^[^?#]*(.*)$", 1)
    return (
        F.when(h == "", b)
        .when(h.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, h))
        .when(h.startswith("#"), F.concat(drop_fragment(b), h))
        .when(h.startswith("?"), F.concat(origin, F.when(base_path == "", F.lit("/")).otherwise(base_path), h))
        .when(h.startswith("/"), F.concat(origin, _fold_dots(h_path), h_rest))
        .otherwise(F.concat(origin, _fold_dots(F.concat(base_dir, h_path)), h_rest))
    )


def resolve_link(href, base) -> Column:
    """Absolute link target without fragment, or NULL for links that lead to no page."""
    h = strip_blanks(href)
    target = drop_fragment(join_url(base, h))
    dead = (h == "") | F.lower(h).rlike(r"^(#|mailto:|tel:|javascript:|data:)")
    ok = url_scheme(target).isin("http", "https") & (url_host(target) != "")
    return F.when(~dead & ok, target)


def entity_key(node_id, page_url) -> Column:
    """Identity of a structured-data @id: resolved, ``www.`` folded, fragment kept."""
    absolute = join_url(page_url, node_id)
    return F.when(url_host(absolute) != "", issue_url_key(absolute)).otherwise(strip_blanks(node_id))


def utm_param(url, name: str) -> Column:
    """Value of a ``utm_*`` parameter, NULL when absent."""
    return F.nullif(F.regexp_extract(_c(url), rf"[?&]utm_{name}=([^&#]*)", 1), F.lit(""))
