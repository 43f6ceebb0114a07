"""Suffix-array dedup: bytes that a document shares, in strings of 50 bytes, with a document of smaller id.

1. Blocks of documents, dealt by id, are cut at minimizers: the first least-hashed 16-byte gram of each 50-byte window. Equal windows have
   equal minimizers at the same place, so a window can only repeat where its minimizer does. Blocks send each different
   minimizer key once, to a bucket of the key; the bucket answers which occur in more than one block.
2. For repeated minimizers the block sends the text that its windows cover, each different piece once, to a bucket of the minimizer.
3. A bucket merges equal pieces, drops the windows whose hash occurs in one piece only, and puts what remains of different
   pieces in a suffix array (:mod:`.suffixes`). Runs of suffixes that agree in 50 bytes are the repeated windows; each
   gets the smallest id that has it. The hashes only leave text out; equality is decided by whole bytes.
4. Blocks apply the answers to their documents.

All groups are blocks or buckets of bounded size: a minimizer comes once from each block however many documents have it, and
one that comes from very many blocks is dealt out by single windows instead, of which copies are again sent once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ranges, utf8_rows
from .suffixes import Strings, equal_windows, words_at

WIDTH = 50
GRAM = 16
REACH = WIDTH - GRAM  # positions from a window's start to its last gram
# Bytes of text in a block; bytes of text that are cut at once; blocks from which a hot minimizer comes.
BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 19
HOT_BLOCKS = 4096
LAST_ID = np.iinfo(np.int64).max

KEYS = "bucket long, block long, kind int, data binary"
KEYS_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays), "zstd", asbytes=True)


def _pack(*arrays: np.ndarray) -> bytes:
    size = sum(a.nbytes + 8 for a in arrays)
    return np.int64(size).tobytes() + _packed(*arrays)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    size = int(np.frombuffer(data[:8], np.int64)[0])
    raw = pa.decompress(data[8:], size, "zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        n = int(np.frombuffer(raw[at:at + 8], np.int64)[0])
        out.append(np.frombuffer(raw[at + 8:at + 8 + n], kind))
        at += 8 + n
    return out


class Block:
    """Documents of a block in order of id and text, as bytes end to end."""

    def __init__(self, table: pa.Table, slice_bytes: int):
        self.slice_bytes = slice_bytes
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        texts = table.column("text").combine_chunks()
        if len(ids) and (np.diff(ids[order]) == 0).any():  # rows that repeat an id go by text
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i].as_py() or "")))
        texts = texts.take(pa.array(order))
        self.ids = ids[order]
        self.doc_id = table.column("doc_id").combine_chunks().take(pa.array(order))
        self.rest = table.column("rest").combine_chunks().take(pa.array(order))
        self.raw, self.offsets = utf8_rows(texts.cast(pa.large_string()))

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, minimizer position, first and last window start of each run of windows with one minimizer."""
        sizes = np.diff(self.offsets)
        found, first = [], 0
        while first < len(sizes):
            # Whole documents, some at a time; a longer document is cut into slices that overlap by a window.
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + self.slice_bytes, side="right")) - 1)
            a, b = int(self.offsets[first]), int(self.offsets[last])
            if last == first + 1 and b - a > 2 * self.slice_bytes:
                parts = [(x, min(x + self.slice_bytes + WIDTH - 1, b)) for x in range(a, b - WIDTH + 1, self.slice_bytes)]
            else:
                parts = [(a, b)]
            found += [self._cut(x, y, first, last) for x, y in parts]
            first = last
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        doc, at, start, stop = (np.concatenate(c) for c in zip(*found))
        # Runs that a slice border has cut become one again.
        joined = np.zeros(len(at), bool)
        joined[1:] = (at[1:] == at[:-1]) & (doc[1:] == doc[:-1])
        head = np.nonzero(~joined)[0]
        tail = np.append(head[1:], len(at)) - 1
        return doc[head], at[head], start[head], stop[tail]

    def _cut(self, a: int, b: int, first: int, last: int):
        n = b - a
        empty = tuple(np.zeros(0, np.int64) for _ in range(4))
        if n < WIDTH:
            return empty
        h = self.raw[a:b].astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(0x85EBCA77)
        width = 1
        while width < GRAM:
            h = h[:-width] * np.uint32(0xC2B2AE3D) + h[width:]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x27D4EB2F)
            width *= 2
        least = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= REACH + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = REACH + 1 - span
        if rest:
            least = np.minimum(least[:len(least) - rest], least[rest:])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows within one document: those that do not start in the last 49 bytes before a border.
        sound = np.ones(n - WIDTH + 1, bool)
        for border in self.offsets[first + 1:last]:
            sound[max(0, int(border) - a - WIDTH + 1):max(0, int(border) - a)] = False
        new = np.empty(len(at), bool)
        new[0] = True
        np.not_equal(at[1:], at[:-1], out=new[1:])
        new[1:] |= sound[1:] != sound[:-1]
        start = np.nonzero(new)[0]
        stop = np.append(start[1:], len(at)) - 1
        ok = sound[start]
        start, stop = start[ok], stop[ok]
        doc = np.searchsorted(self.offsets, start + a, side="right") - 1
        return doc, at[start] + a, start + a, stop + a

    def keys(self, at: np.ndarray) -> np.ndarray:
        """64-bit keys of the grams at these positions."""
        gram = self.raw[at[:, None] + np.arange(GRAM)].view(np.uint64).reshape(-1, GRAM // 8)
        return _mix(_mix(gram[:, 0]) + gram[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _distinct(keys: np.ndarray, buckets: int):
    """Different keys in order of bucket and key, where each bucket's begin, and each key's place among them."""
    different, place = np.unique(keys, return_inverse=True)
    of = _bucket_of(different, buckets)
    order = np.argsort(of, kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return different[order], np.searchsorted(of[order], np.arange(buckets + 1)), back[place]


def _ask(buckets: int, slice_bytes: int):
    def ask(table: pa.Table) -> pa.Table:
        block = Block(table, slice_bytes)
        _, at, _, _ = block.pieces()
        different, bounds, _ = _distinct(block.keys(at), buckets)
        used = np.nonzero(np.diff(bounds))[0]
        low = different.view(np.uint8).reshape(-1, 8)[:, :5]
        return pa.table([used, np.full(len(used), table.column("block")[0].as_py()), np.zeros(len(used), np.int32),
                         [low[bounds[b]:bounds[b + 1]].tobytes() for b in used]], schema=KEYS_ARROW)
    return ask


def _answer(hot_blocks: int):
    return lambda table: _bits(table, hot_blocks)


def _bits(table: pa.Table, hot_blocks: int) -> pa.Table:
    """For each block of the bucket, bits of its keys: in another block too; in so many that it is hot."""
    data = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 5) for x in table.column("data")]
    counts = [len(x) for x in data]
    wide = np.zeros((sum(counts), 8), np.uint8)
    wide[:, :5] = np.concatenate(data)
    _, place, times = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    bits = [np.packbits(np.stack((times[p] > 1, times[p] > hot_blocks)), axis=1).tobytes() for p in np.split(place, ends[:-1])]
    return pa.table([table.column("bucket").combine_chunks(), table.column("block").combine_chunks(),
                     pa.array(np.zeros(len(bits), np.int32)), pa.array(bits, pa.binary())], schema=KEYS_ARROW)


class Flagged:
    """Pieces of a block whose minimizer repeats, each different one once, in order of bucket and smallest document."""

    def __init__(self, block: Block, replies: pa.Table, buckets: int):
        doc, at, start, stop = block.pieces()
        keys = block.keys(at)
        different, bounds, place = _distinct(keys, buckets)
        flags = np.zeros((2, len(different)), bool)
        for bucket, kind, data in zip(*(replies.column(c).to_pylist() for c in ("bucket", "kind", "data"))):
            if kind == 0:
                n = int(bounds[bucket + 1] - bounds[bucket])
                bits = np.frombuffer(data, np.uint8).reshape(2, -1)
                flags[:, bounds[bucket]:bounds[bucket + 1]] = np.unpackbits(bits, axis=1)[:, :n].astype(bool)
        # Repeated within the block: in more than one of its documents.
        low, high = np.full(len(different), LAST_ID), np.full(len(different), -1, np.int64)
        np.minimum.at(low, place, doc)
        np.maximum.at(high, place, doc)
        flags[0] |= low < high
        mine = np.nonzero(flags[0][place])[0]
        hot = flags[1][place[mine]]
        keys, doc, at, start, stop = keys[mine], doc[mine], at[mine], start[mine], stop[mine]
        if hot.any():  # single windows instead
            n = np.where(hot, stop - start + 1, 1)
            inside = ranges(np.zeros(len(n)), n)
            keys, doc, at, start, stop, hot = (np.repeat(x, n) for x in (keys, doc, at, start, stop, hot))
            start = np.where(hot, start + inside, start)
            stop = np.where(hot, start, stop)
        row = np.zeros((len(at), 96), np.uint8)
        length = stop - start + WIDTH
        cells = ranges(np.arange(len(at)) * 96 + 8, length)
        row.ravel()[cells] = block.raw[ranges(start, length)]
        row[:, 0], row[:, 1] = length, at - start
        if hot.any():  # dealt by the window itself
            words = row[hot].view(np.uint64)
            spread = np.zeros(len(words), np.uint64)
            for c in range(words.shape[1]):
                spread = _mix(spread + words[:, c])
            keys = keys.copy()
            keys[hot] = spread
        whole = row.view("V96").ravel()
        _, head, same = np.unique(whole, return_index=True, return_inverse=True)
        least = np.full(len(head), LAST_ID)
        most = np.full(len(head), np.iinfo(np.int64).min)
        np.minimum.at(least, same, block.ids[doc])
        np.maximum.at(most, same, block.ids[doc])
        bucket = _bucket_of(keys[head], buckets)
        order = np.lexsort((head, least, bucket))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.row, self.least, self.most = row[head][order], least[order], most[order]
        self.bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        self.doc, self.start, self.piece = doc, start, back[same]


def _send(buckets: int, slice_bytes: int):
    def send(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(docs):
            return KEYS_ARROW.empty_table()
        f = Flagged(Block(docs, slice_bytes), replies, buckets)
        used = np.nonzero(np.diff(f.bounds))[0]
        data = []
        for b in used:
            s = slice(f.bounds[b], f.bounds[b + 1])
            row, length = f.row[s], f.row[s, 0].astype(np.int64)
            text = row.ravel()[ranges(np.arange(len(row)) * 96 + 8, length)]
            data.append(_pack(np.diff(f.least[s], prepend=0), f.most[s] - f.least[s], row[:, 0].copy(), row[:, 1].copy(), text))
        return pa.table([used, np.full(len(used), key[0].as_py()), np.zeros(len(used), np.int32), data], schema=KEYS_ARROW)
    return send


def _judge(table: pa.Table) -> pa.Table:
    """The repeated windows of a bucket: for each block, (piece, first window, windows, smallest id) runs."""
    blobs = [_unpack(x.as_py(), np.int64, np.int64, np.uint8, np.uint8, np.uint8) for x in table.column("data")]
    counts = np.array([len(b[0]) for b in blobs])
    least = np.concatenate([np.cumsum(b[0]) for b in blobs])
    most = least + np.concatenate([b[1] for b in blobs])
    length = np.concatenate([b[2] for b in blobs]).astype(np.int64)
    n = len(least)
    row = np.zeros((n, 96), np.uint8)
    row[:, 0] = length
    row[:, 1] = np.concatenate([b[3] for b in blobs])
    row.ravel()[ranges(np.arange(n) * 96 + 8, length)] = np.concatenate([b[4] for b in blobs])
    # Equal pieces are one class.
    _, head, of = np.unique(row.view("V96").ravel(), return_index=True, return_inverse=True)
    first = np.full(len(head), LAST_ID)
    np.minimum.at(first, of, least)
    row, length = row[head], length[head]
    windows = length - WIDTH + 1
    base = np.cumsum(windows) - windows
    owner = np.repeat(first, windows)  # smallest id of each window of each class
    _contested(row, length, windows, base, first, owner)
    # Runs of windows of one owner that some document of the piece comes after.
    w = windows[of]
    flat = ranges(base[of], w)
    piece = np.repeat(np.arange(n), w)
    hit = owner[flat] < most[piece]
    flat, piece = flat[hit], piece[hit]
    inside = flat - base[of[piece]]
    new = np.ones(len(flat), bool)
    new[1:] = (piece[1:] != piece[:-1]) | (flat[1:] != flat[:-1] + 1) | (owner[flat[1:]] != owner[flat[:-1]])
    start = np.nonzero(new)[0]
    run = np.diff(np.append(start, len(flat)))
    piece, inside, who = piece[start], inside[start], owner[flat[start]]
    ends = np.cumsum(counts)
    cut = np.searchsorted(piece, np.concatenate(([0], ends)))
    kept, data = [], []
    for i in range(len(counts)):
        s = slice(cut[i], cut[i + 1])
        if cut[i + 1] > cut[i]:
            kept.append(i)
            data.append(_pack((piece[s] - (ends[i] - counts[i])).astype(np.int32), inside[s].astype(np.uint8), run[s].astype(np.uint8), who[s]))
    kept = np.array(kept, np.int64)
    blocks = table.column("block").to_numpy()[kept]
    return pa.table([table.column("bucket").to_numpy()[kept], blocks, np.ones(len(kept), np.int32), data], schema=KEYS_ARROW)


def _contested(row, length, windows, base, first, owner) -> None:
    """Lower ``owner`` where different classes hold equal windows."""
    n = len(row)
    at = row[:, 1].astype(np.int64)
    gram = row[np.arange(n)[:, None], 8 + at[:, None] + np.arange(GRAM)].copy().view(np.uint64)
    key = _mix(_mix(gram[:, 0]) + gram[:, 1])
    _, of, times = np.unique(key, return_inverse=True, return_counts=True)
    some = np.nonzero(times[of] > 1)[0]
    if not len(some):
        return
    # Hashes of all windows of these classes, by differences of the hashes of their prefixes.
    hashes, which = [], []
    power = np.uint64(pow(0x9E3779B97F4A7C15, WIDTH, 1 << 64))
    for a in range(0, len(some), 1 << 14):
        part = some[a:a + (1 << 14)]
        prefix = np.zeros((len(part), 89), np.uint64)
        for c in range(88):
            prefix[:, c + 1] = prefix[:, c] * np.uint64(0x9E3779B97F4A7C15) + row[part, 8 + c]
        wide = prefix[:, WIDTH:] - prefix[:, :-WIDTH] * power
        mine = np.repeat(np.arange(len(part)), windows[part])
        inside = ranges(np.zeros(len(part)), windows[part])
        hashes.append(_mix(wide[mine, inside] + key[part][mine] + (at[part][mine] - inside).astype(np.uint64)))
        which.append(part[mine])
    hashes, which = np.concatenate(hashes), np.concatenate(which)
    flat = ranges(base[some], windows[some])
    order = np.argsort(hashes)
    h = hashes[order]
    equal = h[1:] == h[:-1]
    again = np.zeros(len(h), bool)
    again[order[1:]] |= equal
    again[order[:-1]] |= equal
    flat, which = flat[again], which[again]
    if not len(flat):
        return
    # What remains of a class: its runs of such windows, as strings; equal strings of different classes are one.
    new = np.ones(len(flat), bool)
    new[1:] = (which[1:] != which[:-1]) | (flat[1:] != flat[:-1] + 1)
    start = np.nonzero(new)[0]
    run = np.diff(np.append(start, len(flat)))
    c = which[start]
    inside = flat[start] - base[c]
    size = run + WIDTH - 1
    cell = np.zeros((len(start), 96), np.uint8)
    cell[:, 0] = size
    cell.ravel()[ranges(np.arange(len(start)) * 96 + 8, size)] = row.ravel()[ranges(c * 96 + 8 + inside, size)]
    _, one, string = np.unique(cell.view("V96").ravel(), return_index=True, return_inverse=True)
    low = np.full(len(one), LAST_ID)
    np.minimum.at(low, string, first[c])
    size_one = size[one]
    strings = Strings(cell.ravel()[ranges(one * 96 + 8, size_one)], size_one)
    order, same = equal_windows(strings, WIDTH)
    least = np.full(int(same.max(initial=-1)) + 1, LAST_ID)
    np.minimum.at(least, same, low[strings.of[order]])
    by_position = np.full(strings.n, LAST_ID)
    by_position[order] = least[same]
    owner[flat] = np.minimum(owner[flat], by_position[ranges(strings.start[string], run)])


def _apply(buckets: int, slice_bytes: int, keep: bool):
    def apply(key, docs: pa.Table, replies: pa.Table) -> pa.Table:
        block = Block(docs, slice_bytes)
        n = len(block.ids)
        covered = np.zeros(len(block.raw) + 1, np.int32)
        told = [(b, d) for b, k, d in zip(*(replies.column(c).to_pylist() for c in ("bucket", "kind", "data"))) if k == 1]
        if n and told:
            f = Flagged(block, replies, buckets)
            order = np.argsort(f.piece, kind="stable")
            bounds = np.searchsorted(f.piece[order], np.arange(len(f.row) + 1))
            for bucket, data in told:
                piece, inside, run, who = _unpack(data, np.int32, np.uint8, np.uint8, np.int64)
                piece = piece + f.bounds[bucket]
                times = bounds[piece + 1] - bounds[piece]
                place = order[ranges(bounds[piece], times)]
                inside, run, who = (np.repeat(x, times).astype(np.int64) for x in (inside, run, who))
                later = block.ids[f.doc[place]] > who
                a = f.start[place[later]] + inside[later]
                np.add.at(covered, a, 1)
                np.add.at(covered, a + run[later] + WIDTH - 1, -1)
        gone = np.cumsum(covered[:-1]) > 0
        edge = np.diff(np.concatenate(([0], gone.view(np.int8))))
        rise = edge == 1
        # A run that ends one document and one that begins the next are two.
        borders = block.offsets[1:-1]
        borders = borders[borders < len(gone)]
        rise[borders] = gone[borders]
        total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[block.offsets])
        n_gone = total(gone) if len(gone) else np.zeros(n, np.int64)
        n_spans = total(rise) if len(gone) else np.zeros(n, np.int64)
        kept = block.raw[~gone].tobytes()
        ends = np.concatenate(([0], np.cumsum(np.diff(block.offsets) - n_gone)))
        texts = [kept[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        return pa.table({
            "doc_id": block.doc_id, "n_bytes": np.diff(block.offsets), "n_removed": n_gone.astype(np.int64),
            "n_spans": n_spans.astype(np.int64), "rest": block.rest, "kept": pa.array([t.decode("utf-8", "ignore") if keep else None for t in texts], pa.string()),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())})
    return apply


def repeated_bytes(docs: DataFrame, keep_text: bool = False, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
                   hot_blocks: int = HOT_BLOCKS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, rest, kept, kept_sha256`` per row of ``docs`` (``doc_id, text``).

    Texts are UTF-8 bytes, null ones empty. Each byte is removed that is covered by a 50-byte string which also starts in a document
    with a smaller id, judged on the input. ``kept`` is the remaining text if ``keep_text``, without
    characters that lost some of their bytes, else null; ``rest`` the columns
    ``carry`` in order, as fields ``c0, c1, ...``.
    Rows that repeat an id do not count against each other; rows without an id come after all others. Texts under 50 bytes keep
    all. Empty tables give no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    # Rows without an id are dealt by their text, as they may be many.
    own = F.col("doc_id").cast("long")
    deal = F.pmod(F.when(own.isNull(), F.xxhash64("text")).otherwise(F.xxhash64(own)), F.lit(blocks))
    rest = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("none"))
    dealt = docs.select(deal.alias("block"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("id"),
                        F.col("doc_id").cast("long").alias("doc_id"), "text", rest.alias("rest"))
    result = (dealt.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long")
              .add("rest", dealt.schema["rest"].dataType).add("kept", "string").add("kept_sha256", "string"))
    dealt = dealt.groupBy("block")
    answers = dealt.applyInArrow(_ask(blocks, slice_bytes), KEYS).groupBy("bucket").applyInArrow(_answer(hot_blocks), KEYS)
    pieces = dealt.cogroup(answers.groupBy("block")).applyInArrow(_send(blocks, slice_bytes), KEYS)
    judged = pieces.groupBy("bucket").applyInArrow(_judge, KEYS)
    return dealt.cogroup(answers.unionByName(judged).groupBy("block")).applyInArrow(_apply(blocks, slice_bytes, keep_text), result)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` cut to what :func:`repeated_bytes` keeps and ``n_chars``, if there, counted anew; a character that
    lost some of its bytes goes as a whole. Documents of whose text nothing is left are dropped; all others stay, with texts
    that lost nothing, null ones too, as they were."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    cut = repeated_bytes(docs, True, others).filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_bytes")))
    was = {c: F.col("rest")[f"c{i}"] for i, c in enumerate(others)}
    text = F.when(F.col("n_removed") == 0, was["text"]).otherwise(F.col("kept"))
    now = was | {"doc_id": F.col("doc_id"), "text": text}
    if "n_chars" in was:
        now["n_chars"] = F.when(F.col("n_removed") == 0, was["n_chars"]).otherwise(F.length(text))
    return cut.select(*[now[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
