"""String, list, JSON and formatting expressions."""

from __future__ import annotations

import html.entities as _entities
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Code points Python's str.split() and str.strip() treat as white space.
SPACE_CHARS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))

# The same as members of a regex class.
_SPACE_CLASS = "".join(rf"\x{{{ord(c):x}}}" for c in SPACE_CHARS)


# The HTML named character references that pages use most, looked up first.
NAMED_ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0",
    "copy": "©", "reg": "®", "trade": "™", "middot": "·", "bull": "•",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€",
    "pound": "£", "yen": "¥", "cent": "¢", "sect": "§", "deg": "°",
    "times": "×", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç",
    "auml": "ä", "ouml": "ö", "uuml": "ü", "szlig": "ß", "ntilde": "ñ",
}

# All named references of the standard as one text, ``name;`` and character in turn, for lookup in the JVM.
_MARK = "\u0001"
ALL_ENTITIES = _MARK + _MARK.join(f"{k}{v}" for k, v in sorted(_entities.html5.items()) if k.endswith(";")) + _MARK

_ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas where Spark shares nothing."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_literal(text: str) -> str:
    """Spark SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def sql_let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def apply_sql(value: Column, name: str, body: str) -> Column:
    """:func:`let` with a SQL body: one parse instead of one call per node, so plans build fast."""
    return F.get(F.call_function("transform", F.array(value), F.expr(f"{name} -> {body}")), F.lit(0))


def trim_space(text) -> Column:
    """Python ``strip()``: every Unicode white space, not only blanks."""
    return F.btrim(_col(text), F.lit(SPACE_CHARS))


def blank_space(text) -> Column:
    """Every white-space character as a blank. Character mapping, much cheaper than a regex class."""
    return F.translate(_col(text), SPACE_CHARS, " " * len(SPACE_CHARS))


def collapse_space(text) -> Column:
    """Runs of white space become one blank; ends trimmed."""
    return F.trim(F.regexp_replace(blank_space(text), " {2,}", " "))


def words(text) -> Column:
    """Python ``split()``: white-space tokens, empty array for empty text."""
    return F.array_remove(F.split(blank_space(text), " "), "")


def word_count(text) -> Column:
    """Number of white-space tokens; 0 for NULL or empty text."""
    return F.coalesce(F.size(words(F.coalesce(_col(text), F.lit("")))), F.lit(0))


def title_case(text) -> Column:
    """Python ``title()``: a new word starts after every non-letter (``they're`` -> ``They'Re``)."""
    runs = F.regexp_extract_all(_col(text), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def slug(text, max_length: int = 50) -> Column:
    """File-name form: word characters only, hyphens for blanks, cut, then hyphens trimmed."""
    kept = F.regexp_replace(blank_space(text), r"[^\p{L}\p{N}_\- ]", "")
    hyphened = F.regexp_replace(kept, "[- ]+", "-")
    cut = F.regexp_replace(F.substring(hyphened, 1, max_length), r"^-+|-+$", "")
    return or_default(F.lower(cut), "untitled")


def unescape(text) -> Column:
    """Decode HTML character references: numeric ones and every name of the standard that ends in a semicolon, in one
    left-to-right JVM pass, so ``&amp;lt;`` gives ``&lt;``. Text without ``&`` is returned untouched."""
    return apply_sql(_col(text), "ut", unescape_sql("ut"))


def unescape_sql(text: str) -> str:
    """SQL text of :func:`unescape`; ``text`` is a column or lambda variable.

    Cuts at ``&``, decodes the reference each piece starts with and joins again. Code points outside
    Unicode become U+FFFD.
    """
    names = ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in NAMED_ENTITIES.items())
    code = sql_let(
        "if(up.ref rlike '^#[xX]', cast(conv(substr(up.ref, 3), 16, 10) as bigint), cast(substr(up.ref, 2) as bigint))",
        "un", "if(un between 1 and 1114111 and un not between 55296 and 57343, "
              "decode(unhex(lpad(hex(un), 8, '0')), 'UTF-32'), '\ufffd')")
    # Where the name stands in the list of all names, the character behind it.
    named = sql_let(f"locate(concat('{_MARK}', up.ref, ';'), {sql_literal(ALL_ENTITIES)})", "uat",
                    f"if(uat > 0, substring_index(substr({sql_literal(ALL_ENTITIES)}, uat + length(up.ref) + 2, 3), '{_MARK}', 1), null)")
    find = (f"named_struct('piece', ux, 'cut', ui > 0, 'ref', "
            f"if(ui > 0, regexp_extract(ux, {sql_literal(_ENTITY)}, 1), ''))")
    char = f"case when up.ref = '' then null when up.ref like '#%' then {code} else coalesce(try_element_at(map({names}), up.ref), {named}) end"
    decode = f"named_struct('piece', up.piece, 'cut', up.cut, 'n', length(up.ref), 'char', {char})"
    rebuild = "coalesce(uq.char || substr(uq.piece, uq.n + 2), if(uq.cut, '&' || uq.piece, uq.piece))"
    pieces = f"transform(transform(split({text}, '&'), (ux, ui) -> {find}), up -> {decode})"
    return f"if(contains({text}, '&'), array_join(transform({pieces}, uq -> {rebuild}), ''), {text})"


def ellipsis(text, n: int = 40, empty: str = "No title") -> Column:
    """Cut to ``n`` characters plus ``...`` when longer; placeholder for missing text."""
    text = _col(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(
        or_default(text, empty)
    )


def fmt(value, spec: str) -> Column:
    """``'03d'`` zero padding, ``'.1f'``/``'.2f'`` decimals, ``'iso'``/``'stamp'`` timestamps."""
    value = _col(value)
    if spec.endswith("d"):
        width = int(spec[:-1])
        return F.format_string(f"%0{width}d", value.cast("long"))
    if spec.endswith("f"):
        pattern = "0" if int(spec[1:-1]) == 0 else "0." + "0" * int(spec[1:-1])
        return F.call_function("format_number", value.cast("double"), F.lit(pattern))
    if spec == "iso":
        base = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", base).otherwise(F.concat(base, F.lit("."), micros))
    if spec == "stamp":
        return F.date_format(value, "yyyyMMdd_HHmmss")
    raise ValueError(f"unknown format: {spec}")


def join_list(items, sep: str = ", ") -> Column:
    """Array to delimited text; NULL array gives empty text."""
    return F.coalesce(F.array_join(_col(items), sep), F.lit(""))


def contains_any(text, terms: Sequence[str]) -> Column:
    """True when the lower-cased text contains one of ``terms`` as a substring."""
    lowered = F.lower(_col(text))
    return reduce(lambda a, b: a | b, [lowered.contains(t.lower()) for t in terms], F.lit(False))


def or_default(value, default) -> Column:
    """``value or default``: NULL and empty text are both replaced."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), F.lit(default))


def job_key(*cols) -> Column:
    """Repeatable unique key of the given columns; a random UUID when none are given."""
    if not cols:
        return F.expr("uuid()")
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(_col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)


def to_json_record(*cols) -> Column:
    """One JSON object per row, NULL fields kept."""
    return F.to_json(F.struct(*[_col(c) for c in cols]), {"ignoreNullFields": "false"})


def head_text(text, n: int = 5000) -> Column:
    """First ``n`` characters."""
    return F.substring(_col(text), 1, n)


def context_window(tokens: Column, position: Column, before: int = 2, after: int = 2) -> Column:
    """Words around 1-based ``position``, clipped at both ends, joined with blanks."""
    start = F.greatest(F.lit(1), position - before)
    end = F.least(F.size(tokens), position + after)
    return F.array_join(F.slice(tokens, start, end - start + 1), " ")


def ngrams(tokens: Column, low: int = 1, high: int = 3, edge_stopwords: Sequence[str] = (),
           lengths: Sequence[int] | None = None) -> Column:
    """All word n-grams of ``low``..``high`` words, or of just ``lengths``, in reading order per length.

    With ``edge_stopwords``, n-grams that start or end with one of them are left out; words are tested by
    set membership before any n-gram is put together.
    """
    listed = ", ".join(sql_literal(w) for w in edge_stopwords)

    def open_edge(word: str) -> str:
        return f"{word} not in ({listed})" if edge_stopwords else "true"

    def of_length(n: int) -> str:
        rest = [f"get(nt, ni + {k})" for k in range(1, n)]
        whole = " || ' ' || ".join(["nw", *rest])
        last = rest[-1] if rest else "nw"
        keep = f"{open_edge('nw')} and {open_edge(last)}" if rest else open_edge("nw")
        return f"filter(transform(nt, (nw, ni) -> if({keep}, {whole}, null)), nx -> nx is not null)"

    arrays = ", ".join(of_length(n) for n in (range(low, high + 1) if lengths is None else lengths))
    return apply_sql(tokens, "nt", f"concat({arrays})")


def strip_punctuation(token: Column) -> Column:
    """Token without leading and trailing characters other than letters and digits."""
    return F.regexp_replace(token, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def plain_tokens(text) -> Column:
    """Lower-case words without edge punctuation: from the first letter or digit of a token to its last, found in one pass."""
    inner = r"[a-z0-9\p{L}\p{N}]++"
    between = rf"[^a-z0-9\p{{L}}\p{{N}}{_SPACE_CLASS}]++"
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(f"{inner}(?:{between}{inner})*+"), F.lit(0))


def strip_stopwords(phrase, stopwords: Sequence[str]) -> Column:
    """Remove stop words from both ends of a lower-case phrase."""
    alternation = "|".join(stopwords)
    lead = rf"^(?:(?:{alternation})(?: +|$))+"
    trail = rf"(?:(?:^| +)(?:{alternation}))+$"
    return F.regexp_replace(F.regexp_replace(_col(phrase), lead, ""), trail, "")
