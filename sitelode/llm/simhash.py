"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A (23 bits), B (23) and C (18, read as 23). Fingerprints link at 4 or fewer differing
bits; let a, b, c be the differing bits of the segments. Keys that name codewords within 4 bits of a segment (``~``) tolerate two errors
in it, exact ones (``=``) none, and these seven kinds together meet every such pair:

* c = 0: then a or b is at most 2. ``=C ~A`` and ``=C ~B``.
* a = 0 (or b = 0) and c > 0: of the other two segments one has at most 2. ``=A ~B``, ``=A ~C``, ``=B ~A``, ``=B ~C``.
* none is 0: then a and c are at most 2. ``~A ~C``.

Fingerprints that share a key are compared; a bucket gives links that span its groups, not all pairs. Only different fingerprints
are compared, one row each, however many documents have them. Very full buckets are split by parts of the bits that
their key leaves open: with at most 4 errors one of five parts is equal, so no link is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
import xxhash

from ..session import durable
from .components import connected
from .golay import indices
from .common import utf8_rows

LINK_BITS = 4
SHINGLE = 4
SEED = 42
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
# Shingles whose bits are counted at once; fingerprints whose keys are made at once.
CHUNK = 1 << 14
# Buckets above this size are split; buckets up to this size are compared pair by pair.
FULL, SMALL = 4096, 6
KINDS = (("=C", "~A"), ("=C", "~B"), ("=A", "~B"), ("=A", "~C"), ("=B", "~A"), ("=B", "~C"), ("~A", "~C"))
SEGMENTS = {"A": (0, 23), "B": (23, 23), "C": (46, 18)}


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: bit by bit the majority over the XXH64 of its word shingles; 0 without words."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        starts, ends = [0], [len(joined)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts, ends = (ends - lengths)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist()
    hashed = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, CHUNK):
        h = np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        raw, offsets = utf8_rows(batch.column(1))
        data = raw.tobytes()
        prints = [fingerprint(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, np.uint64).view(np.int64))], ["doc_id", "print"])


def _marked_fingerprints(batches):
    for batch in batches:
        plain = pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["doc_id", "text"])
        for made in _fingerprints([plain]):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made.column(1)], ["doc_id", "mark", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, print``: the fingerprint of each row of ``docs`` as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, print long")


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints: (row of the print, key)."""
    segment = {k: ((prints >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for k, (at, n) in SEGMENTS.items()}
    near = {k: indices(v) for k, v in segment.items()}
    rows, found = [], []
    for kind, (first, second) in enumerate(KINDS):
        fuzzy, n2 = near[second[1]]
        if first[0] == "=":
            heads, n1 = segment[first[1]][:, None], np.ones(len(prints), np.int64)
        else:
            heads, n1 = near[first[1]]
        for i in range(heads.shape[1]):
            for j in range(fuzzy.shape[1]):
                mine = np.nonzero((i < n1) & (j < n2))[0]
                rows.append(mine)
                found.append((np.int64(kind) << 40) | (heads[mine, i] << 12) | fuzzy[mine, j])
    return np.concatenate(rows), np.concatenate(found)


def _keyed(batches):
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), CHUNK):
            part = prints[at:at + CHUNK]
            rows, found = keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(part[rows])], ["key", "print"])


def _spanning(group: np.ndarray) -> tuple[list, list]:
    """Links that span the groups of fingerprints linked within one bucket. Each search takes all that it reaches out of the
    rest, so a cluster of close fingerprints costs one pass and gives one link for each member."""
    rest, a, b = np.sort(group), [], []
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= LINK_BITS
            if near.any():
                hit = rest[near]
                a += [at] * len(hit)
                b += hit.tolist()
                queue += hit.tolist()
                rest = rest[~near]
    return a, b


def _linker(most: int):
    return lambda batches: _links(batches, most)


def _links(batches, most: int):
    """Links of each run of equal keys in rows sorted by key; only one run is held over from batch to batch. Runs of up to
    ``most`` rows are compared pair by pair."""
    held_k, held_p = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(k, p):
        first = np.concatenate(([True], k[1:] != k[:-1]))
        starts = np.nonzero(first)[0]
        sizes = np.diff(np.append(starts, len(k)))
        small = np.repeat(sizes <= most, sizes)
        u, left, right = p.view(np.uint64), [], []
        for off in range(1, min(most, int(sizes.max(initial=1)))):
            i = np.nonzero((k[off:] == k[:-off]) & small[:-off])[0]
            i = i[np.bitwise_count(u[i] ^ u[i + off]) <= LINK_BITS]
            left.append(u[i])
            right.append(u[i + off])
        for s, n in zip(starts[sizes > most], sizes[sizes > most]):
            a, b = _spanning(np.unique(u[s:s + n]))
            left.append(np.array(a, np.uint64))
            right.append(np.array(b, np.uint64))
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (left, right))
        keep = a != b
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[keep], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    for batch in batches:
        k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        p = np.concatenate((held_p, batch.column(1).to_numpy(zero_copy_only=False)))
        if not len(k):
            continue
        cut = np.searchsorted(k, k[-1])
        if cut:
            yield of(k[:cut], p[:cut])
        held_k, held_p = k[cut:], p[cut:]
    if len(held_k):
        yield of(held_k, held_p)


def part_of(prints: Column, part: int) -> Column:
    """One of five parts of the 64 bits, 13 bits each but the last."""
    return F.shiftrightunsigned(prints, 13 * part).bitwiseAND(F.lit((1 << 13) - 1))


def links(prints: DataFrame, full: int = FULL, small: int = SMALL) -> DataFrame:
    """``a, b``: links between the different fingerprints of ``prints`` that join the same groups as all links do."""
    keyed = durable(prints.select("print").distinct().mapInArrow(_keyed, "key long, print long"))
    crowded = keyed.groupBy("key").count().filter(F.col("count") > full).select("key", F.lit(True).alias("full"))
    # The five parts of a full bucket's fingerprints are its buckets instead.
    parts = F.transform(F.array(*[F.struct(F.lit(i).alias("i"), part_of(F.col("print"), i).alias("v")) for i in range(5)]),
                        lambda x: F.xxhash64("key", x["i"], x["v"]))
    joined = keyed.join(crowded, "key", "left")
    dealt = joined.select(F.explode(F.when(F.col("full"), parts).otherwise(F.array("key"))).alias("key"), "print")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(small), "a long, b long").distinct()


def _components(prints: DataFrame, full: int, small: int) -> DataFrame:
    """``print, root, component_id`` per different fingerprint of ``prints``: what names its group, and the group's smallest ``doc_id``."""
    classes = durable(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = connected(links(classes, full, small))
    rooted = classes.join(roots.select(F.col("node").alias("print"), "root"), "print", "left").withColumn(
        "root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return durable(rooted.join(least, "root").select("print", "root", "component_id"))


def near_duplicates(docs: DataFrame, full: int = FULL, small: int = SMALL) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``docs`` (``doc_id, text``).

    ``fingerprint``: 16 hex digits; ``component_id``: the smallest ``doc_id`` reachable over links, the document's own included.
    Null and empty texts have the fingerprint zero, which links like any other. Repeated rows are all returned; null ids are never
    the smallest unless a group has no other. Empty tables give no rows.
    """
    prints = durable(fingerprints(docs))
    named = _components(prints, full, small)
    return prints.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, full: int = FULL, small: int = SMALL) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: that of the smallest id, nulls last, then of the smallest hash of its text.

    The row is chosen, not the id: rows that share an id but belong to different groups each stand for their own, and so do rows without
    an id. Rows equal in id and text are in one group and interchangeable. Texts are not shuffled for it; only where a chosen id and
    text stand in several rows are those rows brought together.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    prints = durable(marked.mapInArrow(_marked_fingerprints, "doc_id long, mark long, print long"))
    named = _components(prints, full, small)
    # A group's rows may be a third of the table; the least of them is summed before the shuffle.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    least = prints.groupBy("print").agg(F.min(order).alias("first")).join(named, "print").groupBy("root").agg(F.min("first").alias("first"))
    chosen = least.select(F.col("first.doc_id").alias("_id"), F.col("first.mark").alias("_mark"))
    times = prints.groupBy("doc_id", "mark").count()
    same = times["doc_id"].eqNullSafe(chosen["_id"]) & (times["mark"] == chosen["_mark"])
    chosen = durable(chosen.join(times, same).select("_id", "_mark", (F.col("count") > 1).alias("_again")))

    def rows(again: bool) -> DataFrame:
        own = chosen.filter(F.col("_again") == again)
        mark = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
        return docs.join(own, docs["doc_id"].cast("long").eqNullSafe(own["_id"]) & (mark == own["_mark"]), "left_semi")

    # Repeated rows are rare; only they are dealt out, one task per row's key.
    if chosen.filter("_again").isEmpty():
        return rows(False)
    key = F.struct(F.col("doc_id").cast("long").alias("i"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("m"))
    once = rows(True).withColumn("__key", key).dropDuplicates(["__key"]).drop("__key")
    return rows(False).unionByName(once)
