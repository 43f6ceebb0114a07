"""URL expressions. Splitting follows RFC 3986 appendix B and never fails on odd input."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _col, apply_sql, or_default, sql_let, sql_literal, title_case

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_GROUP = {"PROTOCOL": 1, "AUTHORITY": 2, "PATH": 3, "QUERY": 4, "REF": 5}
_DOTS = r"(?:^|/)\.{1,2}(?:/|$)"


def url_part(url, part: str) -> Column:
    """PROTOCOL (lower case), AUTHORITY, HOST, PATH, QUERY or REF; empty text when absent."""
    url = _col(url)
    if part == "PROTOCOL":
        return F.lower(F.regexp_extract(url, _SPLIT, 1))
    if part == "HOST":
        return F.lower(F.regexp_replace(url_part(url, "AUTHORITY"), r"^.*@|:\d*$", ""))
    return F.regexp_extract(url, _SPLIT, _GROUP[part])


def site_of(url) -> Column:
    """Default site key: the host of an http(s) URL."""
    return url_part(url, "HOST")


def url_root(url) -> Column:
    """``scheme://authority`` of an absolute URL."""
    return F.regexp_extract(_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)


def path_and_query(url) -> Column:
    """Path plus ``?query``; an empty path counts as ``/``."""
    query = url_part(url, "QUERY")
    return F.concat(
        or_default(url_part(url, "PATH"), "/"), F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")
    )


def percent_decode(text) -> Column:
    """Percent-decoding that leaves ``+`` and broken escapes alone."""
    text = _col(text)
    return F.when(
        text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)
    ).otherwise(text)


def url_parts(url) -> Column:
    """All parts as one struct: ``scheme, authority, path, query, ref, root``."""
    url = _col(url)
    return F.struct(
        url_part(url, "PROTOCOL").alias("scheme"), url_part(url, "AUTHORITY").alias("authority"),
        url_part(url, "PATH").alias("path"), url_part(url, "QUERY").alias("query"), url_part(url, "REF").alias("ref"),
        url_root(url).alias("root"))


def _unsplit(scheme: Column, authority: Column, path: Column, query: Column, ref: Column) -> Column:
    rooted = F.when((path == "") | path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.concat(
        scheme, F.lit("://"), authority, rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(ref != "", F.concat(F.lit("#"), ref)).otherwise(""),
    )


def url_join(base, ref, base_parts: Column | None = None) -> Column:
    """Resolve ``ref`` against an absolute http(s) ``base`` as Python's ``urljoin`` does.

    Empty ``?`` and ``#`` are dropped, runs of ``/`` collapse only in relative paths, and
    references with another scheme (``mailto:``) come back unchanged. ``;params`` count as path text. The common ``/path`` form takes one
    test and one concatenation; ``base_parts`` passes a precomputed ``url_parts(base)``.
    """
    base, ref = _col(base), _col(ref)
    parts = url_parts(base) if base_parts is None else base_parts
    root = url_root(base) if base_parts is None else base_parts["root"]
    return (
        F.when(ref == "", base)
        .when(ref.rlike(r"^(?=/)(?!//)(?!.*(?:[\s?#]|/\.))"), F.concat(root, ref))
        .when(ref.rlike(r"^https?://[^\s/?#]+/[^\s?#]*$"), ref)
        .otherwise(_resolve(parts, ref))
    )


def _resolve(base_parts: Column, ref: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(ref, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    bound = F.struct(base_parts.alias("b"), cleaned.alias("ref"), ref.alias("raw"))
    return apply_sql(bound, "j", _RESOLVE)


def _unsplit_sql(scheme: str, authority: str, path: str, query: str, ref: str) -> str:
    rooted = f"if({path} = '' or {path} like '/%', {path}, '/' || {path})"
    return (f"{scheme} || '://' || {authority} || {rooted} || if({query} <> '', '?' || {query}, '') "
            f"|| if({ref} <> '', '#' || {ref}, '')")


def _resolve_sql() -> str:
    """SQL over ``j`` (parts of the base ``b``, the cleaned ``ref`` and the ``raw`` one), following RFC 3986 section 5.2.

    Dot segments are folded left to right: ``.`` is dropped, ``..`` removes its predecessor.
    """
    split = sql_literal(_SPLIT)
    parts = ", ".join(
        f"'{name}', {'lower' if name == 'scheme' else ''}(regexp_extract(j.ref, {split}, {group}))"
        for name, group in (("scheme", 1), ("authority", 2), ("path", 3), ("query", 4), ("ref", 5)))
    step = ("(done, seg) -> case when seg = '..' then slice(done, 1, greatest(size(done) - 1, 0)) "
            "when seg = '.' then done else concat(done, array(seg)) end")
    folded = f"aggregate(split(m, '/'), cast(array() as array<string>), {step})"
    ends_in_dots = sql_literal(r"(?:^|/)\.{1,2}$")
    joined = f"array_join(kept, '/') || if(m rlike {ends_in_dots} and size(kept) > 0, '/', '')"
    undotted = sql_let(sql_let(folded, "kept", joined), "u", "if(u = '', '/', u)")
    resolved = f"if(m rlike {sql_literal(_DOTS)}, {undotted}, m)"
    folder = sql_let("regexp_replace(j.b.path, '[^/]*$', '')", "f", "if(f = '', '/', f)")
    merged = f"if(r.path like '/%', r.path, regexp_replace({folder} || r.path, '/{{2,}}', '/'))"
    full_path = sql_let(sql_let(merged, "m", resolved), "p", _unsplit_sql("j.b.scheme", "j.b.authority", "p", "r.query", "r.ref"))
    query = "if(r.query <> '', r.query, j.b.query)"
    body = (
        "case when r.scheme <> '' and r.scheme <> j.b.scheme then j.raw "
        f"when r.authority <> '' then {_unsplit_sql('j.b.scheme', 'r.authority', 'r.path', 'r.query', 'r.ref')} "
        f"when r.path = '' then {_unsplit_sql('j.b.scheme', 'j.b.authority', 'j.b.path', query, 'r.ref')} "
        f"else {full_path} end")
    return sql_let(f"named_struct({parts})", "r", body)


_RESOLVE = _resolve_sql()


def link_class(target, page_url, base_parts: Column | None = None) -> Column:
    """``internal`` for the page's own authority (port included), ``external`` for other http(s), else NULL."""
    target = _col(target)
    root = url_root(page_url) if base_parts is None else base_parts["root"]
    authority = url_part(page_url, "AUTHORITY") if base_parts is None else base_parts["authority"]
    return (
        F.when(F.startswith(target, F.concat(root, F.lit("/"))), "internal")
        .when(url_part(target, "AUTHORITY") == authority, "internal")
        .when(url_part(target, "PROTOCOL").isin("http", "https"), "external")
    )


def business_name(url, dehyphenate: bool = False, strip_www: bool = False) -> Column:
    """First label of the authority, title-cased."""
    authority = url_part(url, "AUTHORITY")
    if strip_www:
        authority = F.regexp_replace(authority, r"^(?i:www)\.", "")
    label = F.split_part(authority, F.lit("."), F.lit(1))
    return title_case(F.translate(label, "-", " ") if dehyphenate else label)


def normalize_url(url) -> Column:
    """Add ``https://`` when no http(s) scheme is there, lower scheme and host, root path ``/``."""
    url = F.trim(_col(url))
    full = F.when(url.rlike(r"^(?i:https?)://"), url).otherwise(F.concat(F.lit("https://"), url))
    authority = url_part(full, "AUTHORITY")
    userinfo = F.regexp_extract(authority, r"^(.*@)?", 0)
    lowered = F.concat(userinfo, F.lower(F.regexp_replace(authority, r"^.*@", "")))
    return _unsplit(url_part(full, "PROTOCOL"), lowered, or_default(url_part(full, "PATH"), "/"),
                    url_part(full, "QUERY"), url_part(full, "REF"))


def last_segment_phrase(url) -> Column:
    """Text after the last ``/``, ``-`` and ``_`` as blanks, title-cased; NULL when empty."""
    tail = F.translate(F.regexp_extract(_col(url), r"([^/]*)$", 1), "-_", "  ")
    return title_case(F.nullif(tail, F.lit("")))


def is_http_url(url) -> Column:
    """Absolute http(s) URL with a non-empty host and no white space."""
    return F.coalesce(_col(url).rlike(r"^(?i:https?)://[^\s/?#]+(?:[/?#]\S*)?$"), F.lit(False))
