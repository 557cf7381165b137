"""DuckDB text of the URL identities, for the oracle side only."""

PATTERN = r"^([a-zA-Z][a-zA-Z0-9_+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def part(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{PATTERN}', {n})"


def host(u: str) -> str:
    return f"lower(regexp_replace(regexp_replace({part(u, 2)}, '^.*@', ''), ':[0-9]*$', ''))"


def bare(h: str) -> str:
    return f"regexp_replace(regexp_replace(lower({h}), '[.]+$', ''), '^www[.]', '')"


def path(u: str) -> str:
    return f"coalesce(nullif(regexp_replace({part(u, 3)}, ';[^/]*$', ''), ''), '/')"


def short_path(u: str) -> str:
    p = path(u)
    return f"(CASE WHEN length({p}) > 1 THEN regexp_replace({p}, '/+$', '') ELSE {p} END)"


def query(u: str) -> str:
    return f"(CASE WHEN {part(u, 4)} = '?' THEN '' ELSE {part(u, 4)} END)"


def frag(u: str) -> str:
    return f"(CASE WHEN {part(u, 5)} = '#' THEN '' ELSE {part(u, 5)} END)"


def url_key(u: str) -> str:
    return f"(lower({part(u, 1)}) || '://' || {bare(host(u))} || {short_path(u)} || {query(u)})"


def slash_key(u: str) -> str:
    return f"(lower({part(u, 1)}) || '://' || {host(u)} || {short_path(u)} || {query(u)})"


def exact_url(u: str) -> str:
    port = f"regexp_extract({part(u, 2)}, ':([0-9]+)$', 1)"
    shown = (
        f"(CASE WHEN {port} = '' OR (lower({part(u, 1)}) = 'https' AND {port} = '443')"
        f" OR (lower({part(u, 1)}) = 'http' AND {port} = '80') THEN '' ELSE ':' || {port} END)"
    )
    return f"(lower({part(u, 1)}) || '://' || {host(u)} || {shown} || {path(u)} || {query(u)})"


def issue_key(u: str) -> str:
    return f"(lower({part(u, 1)}) || '://' || {bare(host(u))} || {short_path(u)} || {query(u)} || {frag(u)})"
