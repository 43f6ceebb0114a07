"""Benchmark decontamination: windows of ten words of the test items against every window of the documents.

Each benchmark window is filed under its longest word, its anchor. A document word is looked up in the set of anchors; only
where it is one are the words around it compared, as text, with the windows filed there. So a document word costs one lookup, a
hit is verified word for word, and nothing of the documents is shuffled but their hits. The windows and anchors are
sent to all executors while they are small, as measured; beyond that every word is a candidate and the join is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable
from .common import ascii_lower, words_between

WINDOW = 10
# Words before lower-casing, and what stands between them; after it A-Z do not occur.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = WORD.replace("^", "")
# Largest text of all benchmark windows that is sent to every executor.
BROADCAST_BYTES = 32 * 1024 * 1024


def words(text: str = "text") -> Column:
    """Words of a text in order, in their own case; a null text has none."""
    return words_between(F.col(text), GAP)


def folded(word: Column) -> Column:
    """Key under which anchors are looked up: at least as coarse as lower-casing A-Z."""
    return F.lower(word)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``window, length, anchor, offset, items``: each window of the benchmark with the items that hold it. An item with fewer
    words than ``window`` is one window; one without words has none."""
    split = benchmark.select("item_id", words().alias("w")).filter(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("w") - length)
    cut = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, length))).alias("w"))
    longest = F.array_max(F.transform("w", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"), x.alias("x"))))
    return (cut.select("item_id", ascii_lower(F.array_join("w", " ")).alias("window"), F.size("w").alias("length"), longest.alias("a"))
            .groupBy("window").agg(F.first("length").alias("length"), F.min(F.struct(-F.col("a.i"), folded(F.col("a.x")))).alias("a"),
                                   F.collect_set("item_id").alias("items"))
            .select("window", "length", F.col("a.col2").alias("anchor"), F.col("a.col1").alias("offset"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, fingerprint, n_words, hits, n_hit, items`` per row of ``docs`` (``doc_id, text``, others ignored).

    ``hits``: [start, end) word ranges of all windows found, sorted, overlaps kept; ``n_hit``: words in any of them;
    ``items``: ids of the items found; ``fingerprint``: hash of the text, for joins back. Null and empty texts have no words and
    no hits; repeated rows are judged alike and all returned; null item ids are ignored; an empty benchmark hits nothing.
    """
    known = durable(benchmark_windows(benchmark, window))
    size = known.agg(F.sum(F.octet_length("window") + 8 * F.size("items") + 64)).first()[0] or 0
    small = size <= BROADCAST_BYTES
    anchors = [r[0] for r in known.select("anchor").distinct().collect()] if small else []
    split = docs.select("doc_id", F.xxhash64("text").alias("fingerprint"), words().alias("w"),
                        F.monotonically_increasing_id().alias("row"))
    places = F.array_compact(F.transform(
        "w", lambda x, i: F.when(folded(x).isin(anchors), i) if small else i)) if anchors or not small else F.array().cast("array<int>")
    near = F.transform(places, lambda i: F.struct(
        i.alias("at"), folded(F.get("w", i)).alias("anchor"),
        F.slice("w", F.greatest(i - (window - 1), F.lit(0)) + 1, F.lit(2 * window - 1)).alias("around")))
    # One element without an anchor carries the document itself.
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("string").alias("anchor"),
                           F.lit(None).cast("array<string>").alias("around")))
    cut = split.select("doc_id", "fingerprint", "row", F.size("w").cast("long").alias("n_words"), F.concat(own, near).alias("xs"))
    rows = cut.select("doc_id", "fingerprint", "row", "n_words", F.explode("xs").alias("x")).select(
        "doc_id", "fingerprint", "row", "n_words", "x.at", "x.anchor", "x.around")
    found = rows.join(F.broadcast(known) if small else known, "anchor", "left")
    start = F.col("at") - F.col("offset")
    first = start - F.greatest(F.col("at") - (window - 1), F.lit(0))
    text = F.array_join(F.slice("around", F.greatest(first, F.lit(0)) + 1, F.col("length")), " ")
    # The coarse form is cheap to make and rules out nearly all others.
    same = (start >= 0) & (folded(text) == folded(F.col("window"))) & (ascii_lower(text) == F.col("window"))
    found = found.withColumn("hit", F.coalesce(same, F.lit(False))).filter((F.col("at") < 0) | F.col("hit"))
    span = F.struct(start.alias("start"), (start + F.col("length")).alias("end"))
    per_doc = found.groupBy("row", "doc_id", "fingerprint", "n_words").agg(
        F.sort_array(F.collect_set(F.when(F.col("hit"), span))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("hit"), F.col("items"))))).alias("items"))
    covered = F.aggregate(
        "hits", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["to"]))).alias("n"),
                              F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    return per_doc.select("doc_id", "fingerprint", "n_words", "hits", covered.alias("n_hit"), "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without what the benchmark contaminates, in its own columns.

    ``remove="documents"`` drops every document with a hit. ``remove="spans"`` keeps all documents and cuts the hit words, with
    what stands between the words of one hit, from ``text``. Documents without a hit stay as they are, with null or repeated ids too.
    """
    hit = contamination(docs, benchmark, window).filter(F.col("n_hit") > 0).select(
        F.col("doc_id").alias("_hit_id"), F.col("fingerprint").alias("_hit_text"), F.col("hits").alias("_hits")).dropDuplicates(
        ["_hit_id", "_hit_text"])
    same = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_text"])
    if remove == "documents":
        return docs.join(hit, same, "left_anti")
    joined = docs.join(hit, same, "left")
    text = F.when(F.col("_hits").isNull(), docs["text"]).otherwise(without_words(docs["text"], F.col("_hits")))
    return joined.select(*[text.alias(c) if c == "text" else docs[c] for c in docs.columns])


def without_words(text: Column, hits: Column) -> Column:
    """``text`` without the word ranges ``hits``: split at words, each gap kept with the word before it."""
    parts = F.regexp_extract_all(text, F.lit(WORD + "|" + GAP), F.lit(0))
    first_is_gap = (~F.element_at(parts, 1).rlike("^" + WORD)).cast("int")
    kept = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), F.floor((i - first_is_gap) / 2).alias("word"),
                                                             ((i - first_is_gap) % 2 != 0).alias("gap"))),
                    lambda p: ~F.exists(hits, lambda h: (p["word"] >= h["start"]) & F.when(
                        p["gap"], p["word"] < h["end"] - 1).otherwise(p["word"] < h["end"])))
    return F.array_join(F.transform(kept, lambda p: p["x"]), "")
