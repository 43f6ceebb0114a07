"""Main text of web pages by consensus host paths.

Each page scores its containers: by their running text, as paths of tags and classes without numbers. Its own container is the smallest one
that holds all running text; where sections of different paths compete in it, the page votes for the one of most running text. The
votes of all pages of a host are counted in Spark, the most frequent path wins, and every page is read again through it: what stands in
lists of like items after the winner, as reader comments do whatever they are called, is left out on all pages of
the host, also on those where it is longer than the article.

Menus, footers, notices, forms and the like never take part, however long: they are known by tag, role or name.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable

# Largest table of winning paths that is broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
# Unlinked characters from which a block is running text however much of it is linked.
RUNNING = 40

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
                   "sub sup time tt u var math semantics mrow mi mo mn mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mfenced "
                   "mstyle mpadded mphantom menclose".split())
# Their content is not markup, or never running text.
OPAQUE = frozenset("script style noscript template iframe object svg annotation annotation-xml canvas textarea select title audio video".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th tr caption summary address center tbody thead tfoot".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav footer aside form button head menu dialog header fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
# Names of furniture that tell it whatever stands beside them in a class, unless a word of EXCUSED does; and names that
# tell it only beside words of FORMS.
SURE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored cookie cookies consent gdpr comment "
                 "comments disqus newsletter breadcrumb breadcrumbs".split())
EXCUSED = frozenset("no not non has have with without open opened closed enabled disabled on off allow allowed".split())
FURNITURE = frozenset(
    "banner promo promotion nav navbar navigation menu header masthead footer sidebar aside widget notice notices notification alert popup modal "
    "overlay subscribe subscription signup login search share sharing social respond reply replies discussion related recommended "
    "recommendations pagination pager toolbar disclaimer copyright hidden bio".split())
# Words that a class or id of furniture may hold besides: place, size, kind of box, what it lists.
FORMS = frozenset(
    "a area article articles author bar block bottom box bottombar button buttons card center container content cta field first footer form global group "
    "head holder icon icons in inner item items js last left link links list main media message middle mobile module nav news out outer page panel post "
    "posts primary reads right row secondary section site slot small social sticky stories story sub text title top topics unit up wrap wrapper".split())
ROOTS = frozenset("html body main article".split())
# Containers that are read whole, and those that are part of the text around them.
WHOLE = frozenset("main article".split())
PARTS = frozenset("ul ol dl table figure".split())


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
    return found


def _furniture(token: str, within: bool) -> int:
    """2 if a class or id names furniture for sure, 1 if it does so by a word of :data:`FURNITURE` among :data:`FORMS`, else 0."""
    names = [x.lower() for x in NAME.findall(token)]
    if any(x in SURE for x in names):
        return 0 if any(x in EXCUSED for x in names) else 2
    known = [x in FURNITURE and not (within and x in ("header", "masthead")) for x in names]
    return int(any(known) and all(k or x in FORMS for k, x in zip(known, names)))


def _dropped(tag: str, attrs: dict[str, str], within: bool, names: int) -> int:
    """How certainly an element is furniture: 3 by tag, role or being hidden, 2 or 1 by class or id, as :func:`_furniture` says, or as a form; 0
    if it is none. ``names``: 3 for all of this, 2 if forms are none, 1 if only sure names are left, 0 if no names are. A header inside the
    article belongs to it."""
    if tag in ("html", "body"):
        return 0
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I):
        return 3
    if attrs.get("role", "").lower() in ROLES:
        return 3
    if tag == "form":
        return int(names > 2)
    if tag in DROPPED:
        return 0 if tag == "header" and within else 3
    if tag in ROOTS or tag in HEADINGS:
        return 0
    sure = max((_furniture(x, within) for x in (attrs.get("class", "") + " " + attrs.get("id", "")).split()), default=0)
    return sure if sure >= (1, 1, 2, 3)[3 - names] else 0


def blocks(page: str) -> list[tuple[str, str, int]]:
    """``(path, text, linked)`` of each block of text outside furniture in page order: the path of its containers, its text with
    references decoded and white space made one blank, and how many characters of it stand in links."""
    return read(page)[0]


def read(page: str) -> tuple[list[tuple[str, str, int]], frozenset[int]]:
    """The blocks of a page, and the places of those that are text however short: headings, and paragraphs that end a sentence."""
    return outline(page)[:2]


def outline(page: str) -> tuple[list[tuple[str, str, int]], frozenset[int], list[tuple[int, ...]]]:
    """:func:`read`, and for each block which container of each step of its path it stands in, by number.

    An element that a name makes furniture is none if it holds the page's ``main`` or ``h1``, nor, unless the name is sure, if it holds an
    article; the same goes for a form. How much text it holds plays no part. A page of which nothing is left is
    read with its forms, then by sure names alone, then without regard to names.
    """
    for names in (3, 2, 1, 0):
        found, titles, nests, wrapping = _read(page, frozenset(), names)
        if wrapping:
            found, titles, nests, _ = _read(page, wrapping, names)
        if any(len(text) > linked for _, text, linked in found):
            break
    return found, titles, nests


def _read(page: str, kept: frozenset[int], names: int):
    """Blocks, places of certain text, numbers of containers, and where the dropped elements begin that hold the page; ``kept`` are not dropped."""
    found, nests, parts, linked, links, titles = [], [], [], 0, 0, set()
    # Elements so far that hold the page: main and h1, and articles; open roots; places of dropped elements that turn out to hold them.
    mains, articles, roots = 0, 0, 0
    wrapping: set[int] = set()
    stack: list[tuple[str, str, int, int, int, int]] = []  # tag, step of the path, dropped, place, mains, articles
    opened: dict[str, int] = {}
    path, numbers, dropped, at, size = "", [], 0, 0, len(page)

    def flush():
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                inner = [x[0] for x in stack[-2:]]
                if any(t in HEADINGS for t in inner) or "p" in inner and text[-1] in ".!?…":
                    titles.add(len(found))
                found.append((path, text, linked))
                nests.append(tuple(numbers))
        parts, linked = [], 0

    def close(depth: int):
        nonlocal path, dropped, roots
        flush()
        for tag, step, drop, place, main, article in stack[depth:]:
            dropped -= drop > 0
            roots -= tag in WHOLE
            if step:
                numbers.pop()
            if drop in (1, 2) and (mains > main or drop == 1 and articles > article):
                wrapping.add(place)
        del stack[depth:]
        path = "/".join(x[1] for x in stack if x[1])

    while at < size:
        m = TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text and not dropped:
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
            continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in OPAQUE:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        mains += tag in ("main", "h1")
        articles += tag == "article"
        attrs = _attributes(m[3]) if m[3] else {}
        drop = _dropped(tag, attrs, roots > 0, names) if (attrs or tag in DROPPED) and m.start() not in kept else 0
        if tag in INLINE and not drop:
            links += tag == "a"
            continue
        if m[3].rstrip().endswith("/"):
            continue
        # A block ends an open paragraph, an item the item before it.
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == "p" and tag not in INLINE or stack[depth][0] == tag == "li":
                close(depth)
                break
            if stack[depth][0] not in LEAF or stack[depth][0] in ("td", "th"):
                break
        if tag not in INLINE:
            flush()
        step = "" if tag in LEAF or tag in INLINE else ".".join([tag, *sorted(set(x.lower() for x in NAME.findall(attrs.get("class", ""))))])
        stack.append((tag, step, drop, m.start(), mains, articles))
        roots += tag in WHOLE
        dropped += drop > 0
        if step:
            path = f"{path}/{step}" if path else step
            opened[path] = opened.get(path, 0) + 1
            numbers.append(opened[path])
    close(0)
    return found, frozenset(titles), nests, frozenset(wrapping)


def main_path(found: list[tuple[str, str, int]], titles: frozenset[int] = frozenset()) -> str | None:
    """Path of the deepest container outside which there is no running text; None without text. An article is not gone into, nor a
    list, table or figure. ``titles``: places of the blocks in headings, which count as running text however short."""
    if not any(len(text) > linked for _, text, linked in found):
        return None
    held = [path for i, (path, text, linked) in enumerate(found) if i in titles or _running(text, linked)]
    held = held or [path for path, text, linked in found if len(text) > linked]
    best: list[str] = []
    for steps in zip(*(path.split("/") for path in held)):
        tag = steps[0].split(".")[0]
        if tag in PARTS or any(x != steps[0] for x in steps):
            break
        best.append(steps[0])
        if tag in WHOLE:
            break
    return "/".join(best)


def _running(text: str, linked: int) -> bool:
    """Whether a block is running text: more than a word, and not mostly links."""
    return " " in text and len(text) - linked >= min(RUNNING, len(text) / 2)


def _under(at: str, path: str) -> bool:
    return not path or at == path or at.startswith(path + "/")


def text_under(found: list[tuple[str, str, int]], path: str) -> str:
    """Text of the blocks in containers of this path, in page order; of all blocks if it is empty."""
    return "\n".join(text for at, text, _ in found if _under(at, path))


def scores(found: list[tuple[str, str, int]], titles: frozenset[int], own: str) -> dict[str, int]:
    """Running text, in unlinked characters, of each section that competes in the page's own container: the containers with a class right in
    it, and the container itself for the text in no such section. Nothing competes in an article."""
    steps = own.split("/") if own else []
    if steps and steps[-1].split(".")[0] in WHOLE:
        return {own: 1}
    held: dict[str, int] = {}
    for i, (path, text, linked) in enumerate(found):
        if _under(path, own) and (i in titles or _running(text, linked)):
            at = _section(path, own, len(steps))
            held[at] = held.get(at, 0) + len(text) - linked
    return held


def _section(path: str, own: str, depth: int) -> str:
    inner = path.split("/")[depth:depth + 1] if path else []
    if not inner or "." not in inner[0] or inner[0].split(".")[0] in PARTS:
        return own
    return f"{own}/{inner[0]}" if own else inner[0]


def listed(found: list[tuple[str, str, int]], nests: list[tuple[int, ...]], section: str) -> bool:
    """Whether a section is a list of like items: at least two containers of one path in it, or three of its own path."""
    depth, itself, inside = section.count("/"), set(), {}
    for (path, _, _), numbers in zip(found, nests):
        if _under(path, section):
            itself.add(numbers[depth])
            if len(numbers) > depth + 1:
                step = path.split("/")[depth + 1]
                if step.split(".")[0] not in PARTS:
                    inside.setdefault(step, set()).add(numbers[depth + 1])
    return len(itself) > 2 or any(len(x) > 1 for x in inside.values())


def ballot(page: str) -> tuple[str, int, list[str], list[str]] | None:
    """A page's vote: its section of most running text, how much that is, the lists of like items that stand after it, and the containers with
    a class outside the page's own."""
    found, titles, nests = outline(page)
    own = main_path(found, titles)
    if own is None:
        return None
    held = scores(found, titles, own)
    best = max(held, key=lambda x: (held[x], x)) if held else own
    start = next((i for i, (path, _, _) in enumerate(found) if _under(path, best)), 0)
    after = {path for path, _, _ in found[start:]}
    lists = [x for x in held if x not in (best, own) and any(_under(p, x) for p in after) and listed(found, nests, x)]
    outside = {path for path, _, _ in found if not _under(path, own) and not _under(own, path) and "." in path[path.rfind("/") + 1:]}
    return best, held.get(best, 0), sorted(lists), sorted(outside)


def main_text(page: str, path: str | None, beside: list[str]) -> str:
    """Text of a page whose host reads ``path`` and has the lists ``beside`` it: the blocks in the page's own container and under ``path``,
    without those lists; all of its own container if that leaves nothing."""
    found, titles, _ = outline(page)
    own = main_path(found, titles)
    if own is None:
        return text_under(found, path) if path is not None else ""
    taken = [text for at, text, _ in found if (_under(at, own) or path is not None and _under(at, path)) and not any(_under(at, x) for x in beside)]
    return "\n".join(taken) if taken else text_under(found, own)


def _vote(batches):
    for batch in batches:
        rows = []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            vote = ballot(page.as_py() or "")
            if vote:
                rows.append((host, vote[0], None, False, vote[1]))
                rows += [(host, vote[0], other, outside, 0) for outside in (False, True) for other in vote[2 + outside]]
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], ["host", "path", "beside", "outside", "score"])


def _extract(batches):
    for batch in batches:
        texts = [main_text(page.as_py() or "", path.as_py(), beside.as_py() or [])
                 for page, path, beside in zip(batch.column(2), batch.column(3), batch.column(4))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_paths(pages: DataFrame) -> DataFrame:
    """``host, path, beside``: the path that most pages of each host vote for, of paths with equal votes the one of the higher score and then
    the last in order; and the lists that stand after it on at least two of these pages and a quarter of them, and the containers outside the
    page's own on more than half of them."""
    votes = with_host(pages).select("host", "html").mapInArrow(_vote, "host string, path string, beside string, outside boolean, score long")
    counts = durable(votes.groupBy("host", "path", "beside", "outside").agg(F.count(F.lit(1)).alias("count"), F.sum("score").alias("score")))
    winners = counts.filter(F.col("beside").isNull()).groupBy("host").agg(F.max(F.struct("count", "score", "path")).alias("w")).select(
        "host", F.col("w.path").alias("path"), F.col("w.count").alias("votes"))
    often = F.when(F.col("outside"), 2 * F.col("count") > F.col("votes")).otherwise((F.col("count") >= 2) & (4 * F.col("count") >= F.col("votes")))
    known = counts.filter(F.col("beside").isNotNull()).join(winners, ["host", "path"]).filter(often)
    known = known.groupBy("host").agg(F.sort_array(F.collect_set("beside")).alias("beside"))
    return winners.join(known, "host", "left").select("host", "path", "beside")


def with_host(pages: DataFrame) -> DataFrame:
    """``pages`` with its host in lower case; empty without one."""
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select("page_id", "url", "html", F.lower(F.coalesce(host, F.lit(""))).alias("host"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per row of ``pages`` (``page_id, url, html``).

    Null and empty pages have an empty text; pages without a host share one consensus; repeated rows vote and are returned each;
    broken markup is read as far as it goes. Empty tables give no rows.
    """
    paths = durable(host_paths(pages))
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length("path") + F.coalesce(F.octet_length(F.array_join("beside", ",")), F.lit(0)) + 32)).first()[0] or 0
    side = F.broadcast(paths) if size <= BROADCAST_BYTES else paths
    return with_host(pages).join(side, "host", "left").select("page_id", "url", "html", "path", "beside").mapInArrow(
        _extract, pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
