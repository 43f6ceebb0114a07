"""Quality rules by distribution divergence.

A document is measured against references of its language that the corpus itself gives: the histogram of character classes and the
histogram of common words. Far from one of them in Jensen-Shannon distance, it is dropped; a document too short for a histogram to
mean anything is not judged by it. A few plain counts come first, and documents that fail them neither stay nor vote.

References grow with the corpus and follow from all of it:

* A text that holds more than one in ``HEAVY`` of its language's rows votes as one document.
* The class reference is the mean over the nearer half of a language's documents, by distance to the mean over all of them, so junk
  that passes the plain counts does not shape it.
* Common words are those with at least one in ``COMMON`` of a language's words. First words are summed in ``BUCKETS`` by a hash; a common
  word's bucket reaches that share too, so only words of such buckets, few in any corpus, are counted one by one.

Votes are whole numbers, so sums do not depend on the order in which executors add them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import count
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .common import null_key, utf8_rows

# A base failure: fewer words, or more than this share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 0.2, 5
# Guards and limits of the two distances. Chance alone keeps short texts apart from a reference, by the inverse root of their length, so
# below FULL_WORDS words the limit rises by that. Languages of fewer voting documents have no class reference.
CLASS_CHARS, CLASS_LIMIT = 200, 0.3
COMMON_WORDS, FULL_WORDS, WORD_LIMIT = 40, 100, 0.34
LEAST_VOTERS = 20
HEAVY, COMMON, BUCKETS = 1000, 500, 8192
# Longest word that can be common, in bytes.
WORD_BYTES = 64
VOTE, SHARE = 1_000_000, 1 << 20
# Text measured at once; a longer text goes alone.
TEXT_BYTES, PIECE = 8 << 20, 1 << 20

BLANK = re.compile(rb"[\x20\x09-\x0D]")
SENTENCE, SYMBOLS = b".,;:!?'\"()-", b"#*$%&|<>"
(LOWER, UPPER, DIGIT, WHITE, MARK, SYMBOL, OTHER, LATIN, TWO, THREE, FOUR), CLASSES, INNER = range(11), 11, 11


def _class_of(byte: int) -> int:
    """Class of a character by the first byte it has in UTF-8; ``INNER`` for all other bytes of a character."""
    if 0x61 <= byte <= 0x7A:
        return LOWER
    if 0x41 <= byte <= 0x5A:
        return UPPER
    if 0x30 <= byte <= 0x39:
        return DIGIT
    if byte == 0x20 or 0x09 <= byte <= 0x0D:
        return WHITE
    if byte < 0x80:
        return MARK if byte in SENTENCE else SYMBOL if byte in SYMBOLS else OTHER
    return INNER if byte < 0xC0 else LATIN if byte < 0xCA else TWO if byte < 0xE0 else THREE if byte < 0xF0 else FOUR


CLASS = np.array([_class_of(b) for b in range(256)], np.uint8)


class Measures(NamedTuple):
    """Counts of some texts: one row each, the words of all texts as numbers with the ``offsets`` of the texts, and the words."""

    classes: np.ndarray
    lines: np.ndarray
    repeated: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    vocabulary: list[bytes]

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.offsets)

    @property
    def word_chars(self) -> np.ndarray:
        return self.classes.sum(1) - self.classes[:, WHITE]

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < LEAST_WORDS) | (100 * self.repeated > round(100 * MOST_REPEATED) * self.n_words)


def _pieces(data: bytes, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``PIECE`` bytes that end where a word does."""
    while end - start > PIECE:
        blank = BLANK.search(data, start + PIECE, end)
        stop = blank.start() if blank else end
        yield start, stop
        start = stop
    yield start, end


def repeated_words(words: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each text in windows of ``width`` words that the text has twice or more, the first included."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(len(offsets) - 1, np.int64)
    at = np.nonzero(doc[:n] == doc[width - 1:])[0]
    # A hash tells most windows apart; those that agree in it are compared word by word.
    mixed, wide = doc[at].astype(np.uint64), words.astype(np.uint64)
    for j in range(width):
        mixed = (mixed ^ wide[at + j]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    alike = at[np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])]
    covered = np.zeros(len(words) + 1, np.int64)
    if len(alike):
        keys = np.stack([doc[alike], *(words[alike + j] for j in range(width))], 1)
        _, which, times = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
        twice = alike[times[which.reshape(-1)] > 1]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + width, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    return inside[offsets[1:]] - inside[offsets[:-1]]


def measure(column) -> Measures:
    """Counts of every text of a string column; null is empty."""
    raw, ends = utf8_rows(column)
    data, n = raw.tobytes(), len(ends) - 1
    classes, lines, sizes = np.zeros((n, CLASSES), np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    numbers: dict[bytes, int] = {}
    parts = []
    for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        for at, to in _pieces(data, a, b):
            classes[i] += np.bincount(CLASS[raw[at:to]], minlength=CLASSES + 1)[:CLASSES]
            words = data[at:to].split()
            parts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
            sizes[i] += len(words)
        if data.find(b"\n", a, b) >= 0:
            said = [line for line in data[a:b].split(b"\n") if line.strip()]
            lines[i] = len(said) - len(set(said))
    words = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    return Measures(classes, lines, repeated_words(words, offsets), words, offsets, list(numbers))


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``text``, the last column, has about ``TEXT_BYTES``; a longer text goes alone."""
    for batch in batches:
        _, ends = utf8_rows(batch.column(batch.num_columns - 1))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, ends[at] + TEXT_BYTES, side="right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


def _groups(column) -> Iterator[tuple[str, np.ndarray]]:
    """Rows of each value of a string column."""
    coded = column.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    for code, value in enumerate(coded.dictionary.to_pylist()):
        yield value, np.nonzero(which == code)[0]


def word_votes(m: Measures, rows: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Votes of the given rows' words, by number."""
    total = np.zeros(len(m.vocabulary), np.int64)
    for i in rows:
        np.add.at(total, m.words[m.offsets[i]:m.offsets[i + 1]], votes[i])
    return total


def bucket(word: bytes) -> int:
    return zlib.crc32(word) % BUCKETS


def _votes(batches):
    """Rows of two sorts: the class shares of one voting document, or the votes in each bucket that a task's documents of a language give."""
    kept: dict[str, np.ndarray] = {}

    def flush():
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(list(kept)), pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.list_(pa.int64())),
                                              pa.array([v.tolist() for v in kept.values()], pa.list_(pa.int64()))], ["lang", "votes", "shares", "buckets"])
            kept.clear()

    for part in _slices(batches):
        m = measure(part.column(2))
        votes, voting = part.column(1).to_numpy(zero_copy_only=False), ~m.failed
        home = np.array([bucket(w) for w in m.vocabulary], np.int64)
        # Words too long to be common share the last bucket, which none of the others use.
        home[[i for i, w in enumerate(m.vocabulary) if len(w) > WORD_BYTES]] = BUCKETS
        for lang, rows in _groups(part.column(0)):
            rows = rows[voting[rows]]
            sums = kept.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            np.add.at(sums, home, word_votes(m, rows, votes))
        if len(kept) > 64:
            yield from flush()
        rows = np.nonzero(voting & (m.classes.sum(1) >= CLASS_CHARS))[0]
        shares = m.classes[rows] * SHARE // m.classes[rows].sum(1, keepdims=True)
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(votes[rows]), pa.array(shares.tolist(), pa.list_(pa.int64())),
                                          pa.nulls(len(rows), pa.list_(pa.int64()))], ["lang", "votes", "shares", "buckets"])
    yield from flush()


def _counts(batches):
    """Votes for the words of full buckets."""
    for part in _slices(batches):
        m = measure(part.column(3))
        votes, voting = part.column(1).to_numpy(zero_copy_only=False), ~m.failed
        for lang, rows in _groups(part.column(0)):
            full = set(part.column(2)[int(rows[0])].as_py() or ())
            mine = word_votes(m, rows[voting[rows]], votes)
            found = [(w, v) for w, v in zip(m.vocabulary, mine.tolist()) if v and len(w) <= WORD_BYTES and bucket(w) in full]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([w for w, _ in found], pa.binary()),
                                              pa.array([v for _, v in found], pa.int64())], ["lang", "word", "votes"])


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts to one reference of counts; 0 for rows without any."""
    p = p / np.maximum(p.sum(1, keepdims=True), 1)
    q = q / max(q.sum(), 1)
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / middle), 0).sum(1) + np.where(q > 0, q * np.log2(q / middle), 0).sum(1)
    return np.where(p.sum(1) > 0, np.sqrt(np.maximum(bits / 2, 0)), 0.0)


def _judge(batches):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    for part in _slices(batches):
        m = measure(part.column(6))
        apart = {k: np.full(part.num_rows, np.nan) for k in ("classes", "words")}
        for _, rows in _groups(part.column(1)):
            first = int(rows[0])
            shares, words, votes, total = (part.column(c)[first].as_py() for c in (2, 3, 4, 5))
            if shares:
                apart["classes"][rows] = divergence(m.classes[rows], np.array(shares, np.float64))
            if words:
                known = {w: j for j, w in enumerate(words)}
                column = np.array([known.get(w, len(words)) for w in m.vocabulary], np.int64)
                seen = np.stack([np.bincount(column[m.words[m.offsets[i]:m.offsets[i + 1]]], minlength=len(words) + 1) for i in rows])
                apart["words"][rows] = divergence(seen, np.array([*votes, total - sum(votes)], np.float64))
        counts = [m.n_words, m.word_chars, m.classes[:, SYMBOL], m.lines, m.repeated]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in counts), pa.array(m.failed),
                                          *(pa.array(x, from_pandas=True) for x in apart.values())], names)


def _distance(shares: Column, reference: Column) -> Column:
    """:func:`divergence` of two arrays of counts."""
    def parts(x: Column) -> Column:
        total = F.aggregate(x, F.lit(0).cast("double"), lambda a, b: a + b)
        return F.transform(x, lambda c: c / total)

    def bits(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    both = F.zip_with(parts(shares), parts(reference), lambda x, y: bits(x, y) + bits(y, x))
    return F.sqrt(F.greatest(F.aggregate(both, F.lit(0.0), lambda a, b: a + b) / 2, F.lit(0.0)))


def _mean(rows: DataFrame) -> DataFrame:
    """``lang, reference, voters``: summed shares of a language's documents, by votes; any multiple of the mean will do."""
    sums = [F.sum((F.get("shares", F.lit(i)) * F.col("votes")).cast("decimal(38,0)")).cast("double") for i in range(CLASSES)]
    return rows.groupBy("lang").agg(F.array(*sums).alias("reference"), F.sum("votes").alias("voters"))


def class_references(shares: DataFrame, least: int = LEAST_VOTERS) -> DataFrame:
    """``lang, reference`` from ``lang, votes, shares``, one row per document: the mean over the nearer half, by votes."""
    mean = _mean(shares).filter(F.col("voters") >= least * VOTE).withColumnRenamed("reference", "mean")
    placed = durable(shares.join(durable(mean), "lang").withColumn("bin", F.floor(1024 * _distance(F.col("shares"), F.col("mean"))).cast("int")))
    bins = placed.groupBy("lang", "voters", "bin").agg(F.sum("votes").alias("v"))
    upto = F.sum("v").over(Window.partitionBy("lang").orderBy("bin"))
    cut = bins.withColumn("upto", upto).filter(2 * F.col("upto") >= F.col("voters")).groupBy("lang").agg(F.min("bin").alias("cut"))
    return _mean(placed.join(durable(cut), "lang").filter(F.col("bin") <= F.col("cut"))).select("lang", "reference")


def judge(docs: DataFrame, heavy: int = HEAVY, common: int = COMMON, least: int = LEAST_VOTERS, class_limit: float = CLASS_LIMIT,
          word_limit: float = WORD_LIMIT) -> DataFrame:
    """Counts, distances and verdict of each row of ``docs`` (``doc_id, text, lang``).

    ``n_words``, ``word_chars`` (characters in words), ``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that
    equal an earlier one), ``n_repeat_words`` (words in windows of five that the text has twice or more). ``base_failed``: fewer than
    ten words, or over a fifth of them repeated. ``class_distance`` and ``word_distance`` to the references of the row's ``lang``, null
    where it has none. ``kept`` unless the base failed, a text of at least 200 characters lies farther than ``class_limit`` in classes, or one
    of at least 40 words farther than ``word_limit`` in words (times ``sqrt(100 / n_words)`` below 100 words). A null text is empty; a null language is one of its own; a language of
    fewer than ``least`` voting documents has no class reference, and rules without a reference drop nothing. Repeated
    rows are returned each; empty tables give no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_key("lang").alias("lang"),
                        F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    copies = keyed.groupBy("lang", "digest").agg(F.count(F.lit(1)).alias("n"))
    rows = keyed.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # At most ``heavy`` texts of a language.
    often = durable(copies.filter("n > 1").join(rows, "lang").filter(F.col("n") * heavy > F.col("rows")).select(
        "lang", "digest", F.floor(F.lit(VOTE) / F.col("n")).cast("long").alias("vote")))
    voting = keyed.join(often, ["lang", "digest"], "left").withColumn("votes", F.coalesce("vote", F.lit(VOTE).cast("long")))

    voted = durable(voting.select("lang", "votes", "text").mapInArrow(_votes, "lang string, votes long, shares array<long>, buckets array<long>"))
    classes = class_references(voted.filter(F.col("shares").isNotNull()).select("lang", "votes", "shares"), least)
    buckets = voted.filter(F.col("buckets").isNotNull()).select("lang", F.posexplode("buckets").alias("bucket", "v")).groupBy("lang", "bucket").agg(
        F.sum("v").alias("v"))
    totals = buckets.withColumn("total", F.sum("v").over(Window.partitionBy("lang")))
    full = durable(totals.filter((F.col("v") * common >= F.col("total")) & (F.col("bucket") < BUCKETS) & (F.col("v") > 0)).groupBy("lang", "total").agg(
        F.sort_array(F.collect_list("bucket")).alias("full")))
    counted = voting.join(full, "lang").select("lang", "votes", "full", "text").mapInArrow(_counts, "lang string, word binary, votes long")
    words = durable(counted.groupBy("lang", "word").agg(F.sum("votes").alias("v")).join(full.select("lang", "total"), "lang").filter(
        F.col("v") * common >= F.col("total")).groupBy("lang", "total").agg(F.sort_array(F.collect_list(F.struct("word", "v"))).alias("w")))

    references = durable(durable(classes).join(words, "lang", "full_outer").select(
        "lang", "reference", F.col("w.word").alias("words"), F.col("w.v").alias("wv"), "total"))
    judged = keyed.join(references, "lang", "left").select("doc_id", "lang", "reference", "words", "wv", "total", "text").mapInArrow(
        _judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
                "class_distance double, word_distance double")
    chars = F.col("word_chars")
    far = (chars >= CLASS_CHARS) & (F.col("class_distance") > class_limit)
    limit = word_limit * F.sqrt(F.greatest(F.lit(1.0), FULL_WORDS / F.col("n_words")))
    far |= (F.col("n_words") >= COMMON_WORDS) & (F.col("word_distance") > limit)
    return judged.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
