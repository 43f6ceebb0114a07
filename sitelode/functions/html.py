"""Expressions over raw HTML. Each is independent, so unused ones are pruned from the plan.

Known limits of parsing by expression: CDATA sections and tags left open at the end of the
file are read as text. Headings and titles end at the first closing tag of their name; page furniture is cut by nesting.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from .text import (
    SPACE_CHARS, _col, apply_sql, collapse_space, let, sql_let, sql_literal, unescape, unescape_sql, word_count, words,
)

_ATTRS = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"
# Comments and the bodies of script and style; whichever opens first wins.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)"
_TAG = rf"(?s)<(?:/?[A-Za-z](?:{_ATTRS}>|[^>]*>)|[!?][^>]*>)"


def tag_pattern(name: str) -> str:
    """Opening tag of ``name``; ``>`` inside quoted attribute values does not end it."""
    return rf"(?is)<{name}(?=[\s/>])(?:{_ATTRS}>|[^>]*>)"


def attribute(tag, name: str) -> Column:
    """Decoded attribute value of an opening tag, empty text for a bare attribute, NULL when absent."""
    return apply_sql(_col(tag), "at", attribute_sql("at", name))


def attribute_sql(tag: str, name: str) -> str:
    """SQL text of :func:`attribute`; the captured value still has its quotes, which are cut off."""
    other = rf"(?:[\s/]+(?!{name}[\s=/>])[^\s=/>]++(?:\s*=\s*(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']++))?+)*+"
    head = rf"(?is)^<\w+{other}[\s/]+{name}(?=[\s=/>])"
    value = sql_literal(rf"{head}(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?")
    bare = f"if(aq rlike '^[\"\\']', substr(aq, 2, length(aq) - 2), aq)"
    decoded = sql_let(f"regexp_extract({tag}, {value}, 1)", "aq", sql_let(bare, "av", unescape_sql("av")))
    return f"if({tag} rlike {sql_literal(head)}, {decoded}, null)"


def attribute_values(tags: Column, name: str) -> Column:
    """Values of an attribute over an array of tags; tags without it are left out."""
    return F.array_compact(F.call_function("transform", tags, F.expr(f"at -> {attribute_sql('at', name)}")))


def markup(html) -> Column:
    """HTML without comments, scripts and styles."""
    return F.regexp_replace(_col(html), _HIDDEN, "")


def _source(html, cleaned: bool) -> Column:
    """``cleaned=True`` says that the column already holds ``markup``."""
    return _col(html) if cleaned else markup(html)


def inner_text(fragment) -> Column:
    """Text of an element: every text node trimmed, then joined without a separator."""
    return apply_sql(_col(fragment), "ie", inner_text_sql("ie"))


def inner_text_sql(fragment: str) -> str:
    blanks = sql_literal(SPACE_CHARS)
    joined = f"array_join(transform(split({fragment}, {sql_literal(_TAG)}), ip -> btrim(ip, {blanks})), '')"
    return f"btrim({sql_let(joined, 'it', unescape_sql('it'))}, {blanks})"


def page_title(html, cleaned: bool = False) -> Column:
    """Decoded ``<title>``; NULL when absent or empty."""
    raw = F.regexp_extract(_source(html, cleaned), r"(?is)<title(?=[\s>])[^>]*>(.*?)</title\s*>", 1)
    return F.nullif(unescape(raw), F.lit(""))


def meta_description(html, cleaned: bool = False) -> Column:
    """``content`` of the first ``<meta name="description">`` (exact-case name)."""
    tags = F.regexp_extract_all(_source(html, cleaned), F.lit(tag_pattern("meta")), F.lit(0))
    named = f"mt -> coalesce({attribute_sql('mt', 'name')} = 'description', false)"
    first = F.get(F.call_function("filter", tags, F.expr(named)), F.lit(0))
    return attribute(first, "content")


def first_h1(html, cleaned: bool = False) -> Column:
    """Text of the first ``<h1>``; NULL when there is none."""
    pattern = r"(?is)<h1(?=[\s>])[^>]*>(.*?)(?:</h1\s*>|\z)"
    source = _source(html, cleaned)
    return F.when(source.rlike(r"(?i)<h1[\s>]"), inner_text(F.regexp_extract(source, pattern, 1)))


def heading_elements(html, cleaned: bool = False) -> Column:
    """Array of whole h2..h4 elements in document order."""
    return F.regexp_extract_all(_source(html, cleaned), F.lit(r"(?is)<(h[234])(?=[\s>])[^>]*>.*?</\1\s*>"), F.lit(0))


def link_tags(html, cleaned: bool = False) -> Column:
    return F.regexp_extract_all(_source(html, cleaned), F.lit(tag_pattern("a")), F.lit(0))


def image_tags(html, cleaned: bool = False) -> Column:
    return F.regexp_extract_all(_source(html, cleaned), F.lit(tag_pattern("img")), F.lit(0))


def strip_tags(fragment) -> Column:
    return F.regexp_replace(_col(fragment), _TAG, " ")


def shown_text_sql(fragment: str) -> str:
    """SQL text: tags to blanks, references decoded, white space collapsed."""
    stripped = f"regexp_replace({fragment}, {sql_literal(_TAG)}, ' ')"
    blanks = f"translate(st, {sql_literal(SPACE_CHARS)}, {sql_literal(' ' * len(SPACE_CHARS))})"
    collapsed = f"trim(regexp_replace({blanks}, ' {{2,}}', ' '))"
    return sql_let(sql_let(stripped, "sg", unescape_sql("sg")), "st", collapsed)


def visible_text(html) -> Column:
    """All text outside scripts and styles, title included, white space collapsed."""
    shown = F.regexp_replace(_col(html), _HIDDEN, " ")
    return collapse_space(unescape(strip_tags(shown)))


# Dropped from main text: comments, and elements whose bodies hold no elements of their own name.
_UNSEEN = (
    r"(?is)<!--.*?(?:-->|\z)"
    r"|<(script|style|noscript|head|title)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\z)"
)
# Page furniture by element and by class or id; it goes with all that it holds.
FURNITURE = ("nav", "footer", "header", "aside", "form")
_AD = r"(?is)^<\w+\s(?:[^>]*?\s)?(?:class|id)\s*=\s*[\"']ad[\"']"
# A tag, a run of text, or a lone angle bracket: together they are the whole page.
_TOKEN = rf"(?s)</?[A-Za-z](?:{_ATTRS}>|[^>]*>)|[^<]+|<"
# Elements without an end tag, and elements that the next of their kind ends.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
SELF_ENDED = ("p", "li", "dt", "dd", "tr", "td", "th", "option")
_BLOCK = (
    r"(?is)</?(?:p|div|li|ul|ol|td|th|tr|table|h[1-6]|article|section|main|body|html|blockquote|pre|br)"
    r"(?=[\s/>])[^>]*>"
)
_ANCHOR = r"(?is)<a(?=[\s>])[^>]*>(.*?)</a\s*>"


def _quoted(names: Sequence[str]) -> str:
    return ", ".join(sql_literal(n) for n in names)


def without_furniture(html) -> Column:
    """HTML without comments, scripts and page furniture, however deep the furniture nests; a break stands for each part left out.

    One pass over the tags with a stack of open element names. A closing tag ends the innermost open element of its name and
    all inside it; one without an opening tag is ignored. Furniture left open ends with its parent or the page. Only where an
    outermost furniture element ends does the list of cuts grow.
    """
    name = sql_literal(r"^</?([A-Za-z][^\s/>]*)")
    kind = (f"transform(ft, (fx, fi) -> if(fx like '<%', named_struct('i', fi, 'n', lower(regexp_extract(fx, {name}, 1)), "
            f"'close', fx like '</%', 'bad', fx rlike {sql_literal(_AD)}), null))")
    tags = f"filter({kind}, fm -> fm.n <> '' and fm.n not in ({_quoted(VOID)}))"
    at = "array_position(reverse(fz.s), fm.n)"
    ended = f"fm.n in ({_quoted(SELF_ENDED)}) and coalesce(try_element_at(fz.s, -1) = fm.n, false)"
    left = (f"case when fm.close then {sql_let(at, 'fp', 'if(fp > 0, slice(fz.s, 1, size(fz.s) - cast(fp as int)), fz.s)')} "
            f"when {ended} then slice(fz.s, 1, size(fz.s) - 1) else fz.s end")
    done = "fz.k > 0 and size(fl) < fz.k"
    starts = f"not fm.close and (fm.bad or fm.n in ({_quoted(FURNITURE)})) and (fz.k = 0 or ({done}))"
    step = (f"named_struct('s', if(fm.close, fl, fl || array(fm.n)), "
            f"'k', case when {starts} then size(fl) + 1 when {done} then 0 else fz.k end, "
            f"'f', if({starts}, fm.i, fz.f), "
            f"'c', if({done}, fz.c || array(named_struct('a', fz.f, 'b', if(fm.close, fm.i + 1, fm.i))), fz.c))")
    zero = "named_struct('s', cast(array() as array<string>), 'k', 0, 'f', 0, 'c', cast(array() as array<struct<a: int, b: int>>))"
    last = "if(fz.k > 0, fz.c || array(named_struct('a', fz.f, 'b', size(ft))), fz.c)"
    cuts = f"aggregate({tags}, {zero}, (fz, fm) -> {sql_let(left, 'fl', step)}, fz -> {last})"
    part = "array_join(slice(ft, fo.b + 1, coalesce(get(fc, fj).a, size(ft)) - fo.b), '')"
    kept = f"array_join(transform(array(named_struct('a', 0, 'b', 0)) || fc, (fo, fj) -> {part}), '<br>')"
    tokens = F.regexp_extract_all(F.regexp_replace(_col(html), _UNSEEN, "<br>"), F.lit(_TOKEN), F.lit(0))
    return apply_sql(tokens, "ft", sql_let(cuts, "fc", kept))


def main_blocks(html, max_link_share: float = 0.5) -> Column:
    """Ordered, de-duplicated text blocks of the page body without furniture or link lists."""
    pieces = F.split(without_furniture(html), _BLOCK)
    linked = f"array_join(regexp_extract_all(bp, {sql_literal(_ANCHOR)}, 1), ' ')"
    measure = f"named_struct('text', {shown_text_sql('bp')}, 'linked', length({sql_let(linked, 'ba', shown_text_sql('ba'))}))"
    keep = f"bm.text <> '' and bm.linked <= length(bm.text) * cast({float(max_link_share)} as double)"
    body = (f"array_distinct(transform(filter(transform(filter(bs, bp -> not bp rlike '^\\\\s*$'), bp -> {measure}), "
            f"bm -> {keep}), bm -> bm.text))")
    return apply_sql(pieces, "bs", body)


def language_of(text, stopwords: Mapping[str, Sequence[str]]) -> Column:
    """Language whose stop words are most frequent; NULL when none occurs. Ties: first by name."""
    def hits(tokens: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(*listed)))

    def best(tokens: Column) -> Column:
        return F.greatest(*[
            F.struct(hits(tokens, listed).alias("hits"), F.lit(-rank).alias("order"), F.lit(lang).alias("lang"))
            for rank, (lang, listed) in enumerate(sorted(stopwords.items()))
        ])

    winner = let(words(F.lower(_col(text))), best)
    return let(winner, lambda w: F.when(w["hits"] > 0, w["lang"]))


__all__ = [
    "attribute", "first_h1", "heading_elements", "image_tags", "inner_text", "language_of", "link_tags",
    "main_blocks", "markup", "meta_description", "page_title", "strip_tags", "tag_pattern",
    "visible_text", "without_furniture", "word_count",
]
