"""Operators for training data against brute force on small inputs, with nulls, empty and repeated rows, and odd columns."""
import hashlib
import html
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sitelode.llm import chat, components, decontaminate as D, golay, labels, licenses, mixing, pages, quality, repeats, search, simhash, toxicity
from sitelode.llm.suffixes import Strings, equal_windows, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, block string, _ string, row string, size string"


@pytest.fixture
def documents(frame):
    """``documents(*(doc_id, text[, source]))``: a table with further columns whose names clash with inner ones."""
    return lambda *rows: frame(DOCS, *[(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "b", "u", "r", "z") for r in rows])


# --- suffix arrays ---------------------------------------------------------------------------------

def test_suffix_arrays():
    rng = random.Random(5)
    for trial in range(120):
        letters = [97, 0, 98, 255, 32][:rng.choice([1, 2, 3, 5])]
        items = [bytes(rng.choice(letters) for _ in range(rng.randint(1, rng.choice([3, 12, 60])))) for _ in range(rng.randint(1, 10))]
        items += [items[0] * 2, items[-1] + items[0], items[0]]
        s = Strings(np.frombuffer(b"".join(items), np.uint8), np.array([len(i) for i in items]))
        rest = {int(s.start[q]) + i: item[i:] for q, item in enumerate(items) for i in range(len(item) + 1)}
        order = suffix_array(s)
        assert sorted(order) == sorted(rest)
        assert [rest[p] for p in order] == sorted(rest.values())
        width = rng.choice([1, 3, 8, 11])
        at, run = equal_windows(s, width)
        assert sorted(at) == sorted(p for p, t in rest.items() if len(t) >= width)
        for x, y, a, b in zip(at, at[1:], run, run[1:]):
            assert (rest[x][:width] == rest[y][:width]) == (a == b)


def brute_repeats(rows):
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        for j in range(len(raw) - 49):
            first.setdefault(raw[j:j + 50], i)
    last = float("inf")
    found = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - 49):
            at = first[raw[j:j + 50]]
            if (last if at is None else at) < (last if i is None else i):
                gone[j:j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        found.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return found


def repeat_rows():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(4)]
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", *passage]) + " ".join(word() for _ in range(20)))
            for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(120, None), (121, ""), (122, "é" * 25), (123, "é" * 40), (124, "x" * 49), (125, "x" * 200),
                                                         (126, "x" * 200), (126, passage[0]), (126, passage[0]), (None, passage[1])]
    rows += [(None, passage[2] + word()), (None, passage[2]), (None, "tail " + passage[3]), (None, "y" * 120), (None, "y" * 90)]
    return rows + [(130, " ".join(passage) * 20), (131, passage[2][10:] + passage[3][:-7])]


@pytest.mark.parametrize("block,hot,cut", [(1 << 23, 4096, 1 << 19), (2000, 4096, 1 << 19), (3000, 2, 1 << 19), (4000, 4096, 300)])
def test_repeats(documents, values, block, hot, cut):
    rows = repeat_rows()
    got = repeats.repeated_bytes(documents(*rows), block_bytes=block, hot_blocks=hot, slice_bytes=cut)
    assert values(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute_repeats(rows), key=repr)


def test_repeats_removed_from_documents(documents, frame):
    text = "the quick brown fox jumps over the lazy dog and runs away é"
    docs = documents((1, text), (2, "Before " + text + " after"), (3, text), (4, None), (5, ""))
    got = {r["doc_id"]: r for r in repeats.remove_repeats(docs).collect()}
    assert set(got) == {1, 2, 4, 5} and got[1]["text"] == text and got[4]["text"] is None
    assert got[2]["text"] == "Before  after" and got[2]["n_chars"] == 13 and got[2]["block"] == "b"
    assert repeats.remove_repeats(docs.limit(0)).isEmpty()


# --- decontamination -------------------------------------------------------------------------------

def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_hits(rows, items, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    known = defaultdict(set)
    for i, text in items:
        w = split(text)
        n = min(width, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            known[tuple(w[j:j + n])].add(i)
    found = []
    for i, text in rows:
        w, hit, ids = split(text), set(), set()
        for n in {len(k) for k in known}:
            for j in range(len(w) - n + 1):
                if tuple(w[j:j + n]) in known:
                    hit |= set(range(j, j + n))
                    ids |= known[tuple(w[j:j + n])]
        found.append((i, len(w), len(hit), sorted(x for x in ids if x is not None)))
    return found


@pytest.mark.parametrize("limit", [D.BROADCAST_BYTES, 0])
def test_contamination(documents, frame, values, monkeypatch, limit):
    monkeypatch.setattr(D, "BROADCAST_BYTES", limit)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice(["Ab", "c1", "É", "ß", "dd", "eE"]) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(14)) for i in range(6)] + [(7, "Lone"), (8, "ab c1 dd"), (9, None), (10, " .. "), (11, text(10)), (None, text(12))]
    rows = [(i, text(5) + rng.choice(items[:6])[1].upper() + text(3)) for i in range(30)] + [(i, text(40)) for i in range(30, 60)]
    rows += [(60, None), (61, ""), (62, "lone"), (62, "lone"), (None, items[0][1]), (63, items[1][1] * 50), (64, "AB,C1...DD")]
    got = D.contamination(documents(*rows), frame("item_id long, text string, window string", *[(*x, "w") for x in items]))
    have = values(got.withColumn("items", F.array_sort("items")), "doc_id", "n_words", "n_hit", "items")
    assert have == sorted(brute_hits(rows, items), key=repr)
    assert D.contamination(documents(*rows), frame("item_id long, text string")).filter("n_hit > 0").isEmpty()


def test_decontaminated_documents(documents, frame):
    item = "one two three four five six seven eight nine ten"
    bench = frame("item_id long, text string", (1, item))
    docs = documents((1, "Start here. " + item.upper() + "! End here."), (2, "clean text"), (3, None), (None, item), (None, "other"))
    kept = D.decontaminate(docs, bench)
    assert sorted((r["text"] or "") for r in kept.collect()) == ["", "clean text", "other"] and kept.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in D.decontaminate(docs, bench, remove="spans").filter("doc_id is not null").collect()}
    assert cut == {1: "Start here. ! End here.", 2: "clean text", 3: None}


# --- licenses --------------------------------------------------------------------------------------

def test_licenses(documents, spark, frame):
    known = licenses.known_digests(spark)
    docs = documents((1, "Copyright 2020 A. Smith\nReleased  under the MIT Licence."), (2, "text\n# LICENSED UNDER THE APACHE LICENSE, VERSION 2.0.\nmore"),
                     (3, None), (4, ""), (5, "Licensed under the Apache License, Version 20"), (6, "MIT License"), (6, "MIT License"))
    got = sorted((r["doc_id"], r["licenses"], r["n_licenses"], r["whole"]) for r in licenses.scan_licenses(docs, known).collect())
    assert got == [(1, "MIT", 1, True), (2, "Apache-2.0", 1, False), (3, "", 0, False), (4, "", 0, False), (5, "", 0, False),
                   (6, "MIT", 1, True), (6, "MIT", 1, True)]
    own = licenses.known_digests(spark, frame("license_id string, text string", ("B", "do\nas you please"), ("A", "Do as you  please!"), ("C", None)))
    assert [(r["licenses"], r["whole"]) for r in licenses.scan_licenses(documents((1, "Do as\nyou please.")), own).collect()] == [("A", True)]


def test_full_license_texts(documents, spark):
    texts = {f.name.removesuffix(".txt"): f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    rows, want = [], []
    for i, (name, text) in enumerate(sorted(texts.items())):
        short = name.removesuffix(".header")
        body = text.partition("\n\n")[2] if name in ("MIT", "ISC", "Zlib", "BSD-2-Clause", "BSD-3-Clause") else text
        broken = "\n".join(" * " + x for x in re.sub(r"(?i) (copyright (?:notice|holder|owner))", r"\n\1", body).split("\n"))
        rows += [(4 * i, "Copyright (c) 2020 A. Smith\nAll rights reserved.\n\n" + text), (4 * i + 1, f"/*\n{broken}\n */\nint main;"),
                 (4 * i + 2, "Some words before. " + " ".join(body.split()) + " And after."), (4 * i + 3, " ".join(body.split()[:-3]))]
        want += [(4 * i, short, True), (4 * i + 1, short, False), (4 * i + 2, short, False)]
    got = {r["doc_id"]: (r["licenses"], r["whole"]) for r in licenses.scan_licenses(documents(*rows), licenses.known_digests(spark)).collect()}
    assert len(got) == len(rows) and [(i, *got[i]) for i, _, _ in want if got[i][0].split(",") == [""]] == []
    assert [(i, *got[i], x) for i, x, w in want if x not in got[i][0].split(",") or w and not got[i][1]] == []
    cut = next(4 * i + 3 for i, name in enumerate(sorted(texts)) if name == "MIT")
    assert got[cut] == ("", False) and got[cut - 1] == ("MIT", False)


# --- classifiers -----------------------------------------------------------------------------------

def labelled(n=400):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 8)))
    rows, marks = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(20, 80))]
        junk, toxic = i % 4 == 0, i % 5 == 0
        if toxic:
            words = [w if rng.random() > 0.15 else rng.choice(["idiot", "moron", "zorgling"]) for w in words]
        rows.append((i, " ".join(w + "%%%" for w in words) if junk else " ".join(words).capitalize() + "."))
        marks.append((i, int(not junk), int(toxic)))
    return rows, marks


@pytest.mark.parametrize("score,label,least", [(quality.score_quality, "quality", 0.97), (toxicity.score_toxicity, "toxic", 0.95)])
def test_held_out_accuracy(documents, frame, score, label, least):
    rows, marks = labelled()
    marked = frame("doc_id long, quality int, toxic int, text string", *[(*m, "t") for m in marks], (None, 1, 1, ""), (3, None, None, ""))
    got = score(documents(*rows, (500, None), (501, ""), (None, "text"), (7, rows[7][1]), (502, "word " * 20_000)), marked).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: (q if label == "quality" else t) for i, q, t in marks}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (zlib.crc32(str("" if r["doc_id"] is None else r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= least * len(held) > 50
    assert score(documents(*rows[:3]), marked.limit(0)).count() == 3 and score(documents(*rows[:3]).limit(0), marked).isEmpty()


def test_held_out_labels_do_not_count(documents, frame):
    rows, marks = labelled(120)
    out = [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in marks]
    turned = [(i, 1 - q if o else q, 1 - t if o else t) for (i, q, t), o in zip(marks, out)]
    schema = "doc_id long, quality int, toxic int"
    for score in (quality.score_quality, toxicity.score_toxicity):
        a, b = ({(r["doc_id"], round(r["score"], 9)) for r in score(documents(*rows), frame(schema, *m)).collect()} for m in (marks, turned))
        assert a == b


def test_neighbour_votes_are_exact():
    rng = np.random.default_rng(3)
    space = quality.Space(rng.random((40, quality.SIGNS + quality.TERMS), np.float32), rng.integers(0, 2, 40), dims=8)
    terms = rng.random((9, quality.SIGNS + quality.TERMS), np.float32)
    near = space.place(terms) @ space.vectors.T
    for row, got in zip(near, space.vote(terms, 5)):
        top = np.argsort(-row)[:5]
        w = np.exp(quality.SHARPNESS * (row[top].astype(float) - 1)) + 1e-9
        assert got == pytest.approx((w * space.y[top]).sum() / w.sum(), rel=1e-5)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    y = rng.random(3000) < 0.15
    votes = np.stack([np.where(y, rng.random(3000) < on, rng.random(3000) < off) for on, off in ((0.8, 0.02), (0.6, 0.05), (0.7, 0.01))], 1).astype(float)
    votes = np.concatenate((votes, votes[:, :1]), 1)  # a copy adds no evidence
    model = toxicity.LabelModel(votes, votes[:, 0] > 0)
    assert model.prior == pytest.approx(0.15, abs=0.05) and model.on[0] > 0.6 and model.off[0] < 0.06
    assert model.own[0] < 0.8 < model.own[1]
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.95


@pytest.mark.parametrize("n", [40, 3000])
def test_linear_fit_settles_on_separable_votes(n):
    """Rare voters that agree perfectly with the posterior: the fit must be a minimum, whatever the steps on the way."""
    rng = np.random.default_rng(n)
    y = rng.random(n) < 0.1
    x = np.concatenate([np.repeat(y[:, None], 60, 1) & (rng.random((n, 60)) < 0.3), np.repeat(y[:, None], 3, 1), np.zeros((n, 5), bool)], 1).astype(float)
    p = np.where(y, 1 - 1e-9, 1e-9)
    w = toxicity.linear(x, p)
    z = x @ w[:-1] + w[-1]
    penalty = np.append(np.full(x.shape[1], 0.05), 0.0005)
    slope = np.append(x, np.ones((n, 1)), 1).T @ (1 / (1 + np.exp(-z)) - p) + penalty * w
    assert np.abs(w).max() < 50 and np.abs(slope).max() < 1e-2
    assert ((1 / (1 + np.exp(-z)) >= 0.7) == y).all()


def test_civil_documents_stay(documents, frame):
    rows, marks = labelled()
    docs = documents(*rows, (None, "calm words"), (900, None))
    kept = toxicity.keep_civil(docs, frame("doc_id long, quality int, toxic int", *marks))
    ids = [r["doc_id"] for r in kept.collect()]
    toxic = {i for i, _, t in marks if t}
    assert kept.columns == docs.columns and None in ids and 900 in ids
    assert len(toxic & set(ids)) <= 0.1 * len(toxic) and len(set(ids) - toxic) >= 0.98 * (len(rows) - len(toxic))


# --- near duplicates -------------------------------------------------------------------------------

def test_golay_keys_meet_all_close_pairs():
    assert set(golay.COUNTS) == {1, 6}
    rng = np.random.default_rng(7)
    x = rng.integers(0, 2 ** 64, 1500, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for b in rng.choice(64, i % 5, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    keys = []
    for prints in (x, y):
        rows, found = simhash.keys(prints)
        of = defaultdict(set)
        for r, k in zip(rows.tolist(), found.tolist()):
            of[r].add(k)
        keys.append(of)
    assert all(keys[0][i] & keys[1][i] for i in range(len(x)))


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("full,small", [(4096, 6), (3, 2)])
def test_near_duplicates(documents, values, full, small):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(150)] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    rows += [(i, " ".join(word() for _ in range(40))) for i in range(20)]
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "One"), (2004, "oNE"), (2005, rows[0][1].upper()), (2006, rows[0][1]), (2006, rows[0][1]), (None, "one")]
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    top = lambda i: i if group[i] == i else top(group[i])
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                group[top(i)] = top(j)
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        ids = [x for x in (least[top(i)], doc) if x is not None]
        least[top(i)] = min(ids) if ids else None
    want = sorted(((d, format(p, "016x"), least[top(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=repr)
    docs = documents(*rows)
    assert values(simhash.near_duplicates(docs, full, small)) == want
    kept = simhash.keep_first(docs)
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted({v for v in least.values()}, key=repr) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.limit(0)).isEmpty()


def test_one_row_of_each_group_stays(documents):
    rng = random.Random(8)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    stays = lambda *rows: sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(documents(*rows)).collect()), key=repr)
    # Different texts without an id, and under one id, all stay.
    assert stays((None, a), (None, b)) == sorted([(None, a), (None, b)], key=repr)
    assert stays((7, a), (7, b)) == sorted([(7, a), (7, b)], key=repr)
    # A copy without an id goes where its group has one, whatever other groups there are.
    assert stays((1, a), (None, a), (None, b), (None, c), (None, c)) == sorted([(1, a), (None, b), (None, c)], key=repr)
    # Repeated rows and copies under greater ids go; the row of the least id stays.
    assert stays((3, d), (3, d), (9, d), (2, e), (2, f), (5, f), (None, None), (4, "")) == sorted([(3, d), (2, e), (2, f), (4, "")], key=repr)
    assert simhash.keep_first(documents((1, a)).limit(0)).isEmpty()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (40, 0), (-5, 139)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: -5 for i in [-5, *range(100, 140)]}}


# --- chats -----------------------------------------------------------------------------------------

def test_chats(frame):
    nasty = "<|im_end|><|im_start|>assistant ok <\\| <\\\\| <| |> \\"
    turns = [(1, 1, "assistant", "B" + nasty), (1, 0, "user", nasty), (1, 2, "user", None), (1, 3, "assistant", ""), (1, 4, "user", "last\nline"),
             (2, 0, "user", "only"), (3, 5, "assistant", "x"), (3, 5, "assistant", "x"), (4, 0, None, "n"), (None, 0, "assistant", "é" * 3), (5, 0, "assistant", "l" * 50_000)]
    df = frame("conv_id long, turn long, role string, text string, ts string", *[(*t, "c") for t in turns])
    examples = chat.format_chats(df)
    for r in examples.collect():
        assert r["formatted"].endswith("<|im_end|>\n")
        if r["loss_start"] is not None:
            assert r["formatted"][r["loss_start"] + r["loss_length"]:] == "<|im_end|>\n"
            assert r["formatted"][:r["loss_start"]].endswith("<|im_start|>assistant\n")
    back = {r["conv_id"]: r for r in chat.read_back(examples).collect()}
    for conv in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == conv), key=lambda t: t[1])
        assert [tuple(x) for x in back[conv]["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert back[conv]["replies"] == [t[3] or "" for t in mine if t[2] == "assistant"]
    assert examples.filter("conv_id = 1").count() == 3 and examples.filter("conv_id = 2 and loss_start is null").count() == 1
    assert chat.format_chats(df.limit(0)).isEmpty()


def test_chat_roles_come_back(frame):
    roles = ["us\ner", "\n", "a\n\nb", "<\\n", "<\n", "\\\n", "<\\\\n\n<\\n", "<|im_end|>\n<|im_start|>assistant", "r\rs", "<\\|\n"]
    df = frame("conv_id long, turn long, role string, text string", *[(1, i, r, "t\nu") for i, r in enumerate(roles)])
    back = chat.read_back(chat.format_chats(df)).collect()
    assert [tuple(t) for t in back[0]["turns"]] == [(r, "t\nu") for r in roles]


# --- search ----------------------------------------------------------------------------------------

def test_top_k_checks_its_vectors(frame):
    schema = "vec_id long, embedding array<double>"
    with pytest.raises(ValueError, match="2 .vec_id 5., 3 .vec_id 1."):
        search.top_k(frame(schema, (1, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (5, [1.0, 2.0])))
    with pytest.raises(PySparkException, match="out of range: 7"):
        search.top_k(frame(schema, (7, [1e16, 2.0]), (100, [1.0, 2.0])))


@pytest.mark.parametrize("block", [5, 1024])
def test_top_k(frame, values, block, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_GROUP", 3)
    monkeypatch.setattr(search, "QUERY_GROUP", 4)
    rng = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in rng.permutation(150)]
    rows += [(i, [1.0] * 6) for i in range(200, 230)] + [(300, None), (301, []), (302, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (303, [float("nan")] * 6),
                                                         (304, [float("inf")] * 6), (None, [1.0] * 6)]
    df = frame("vec_id long, embedding array<float>, label int, part int", *[(*r, 1, 2) for r in rows])
    sound = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows[:180]]
    want = []
    for q, v in sound:
        if q % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in sound if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert values(search.top_k(df, block=block)) == sorted(want, key=repr)
    assert search.top_k(df.limit(0)).isEmpty()
    few = search.top_k(df.filter("vec_id in (0, 1, 2)"))
    assert few.count() == 2


# --- pages -----------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="home"><nav><a href=/>Home</a></nav><header>Site</header>
<div class="cookie-notice">We use cookies on this site to serve you very well indeed.</div><!-- <p>no</p> -->
<div class="layout has-sidebar"><article><h1>Title &amp; more</h1><p>First   para&shy;graph<br>goes on, with 1 &lt; 2 and &eacute;.<p>Second <b>one<script>var x = "</p>";</script>
<ul><li>item a<li>item b</ul><form><input><p>Sign up</form><aside>related</aside></article>
<div class="sidebar">Many links and so much text beside the article that one may be tempted to take it instead of it.</div>
<section id="comments"><p>Nice article, dear author, I have much to say about it.</p></section></div><footer>&copy; x</footer>"""


def test_page_text():
    found = pages.blocks(PAGE)
    assert pages.main_path(found).endswith("article")
    assert pages.text_under(found, pages.main_path(found)) == "Title & more\nFirst para­graph goes on, with 1 < 2 and é.\nSecond one\nitem a\nitem b"
    assert pages.blocks("") == [] and pages.main_path([]) is None
    assert pages.blocks("plain < text &amp; more") == [("", "plain < text & more", 0)]
    assert [b[1] for b in pages.blocks("<p>open <b>all<div>x</div></p></p>" + "<div>" * 2000 + "deep")] == ["open all", "x", "deep"]


def test_articles_are_read_whole():
    lead, body, item = "Some leading words of it. " * 3, "Body words that go on. " * 8, "<li>an item of the list</li>"
    main = lambda page: pages.text_under(pages.blocks(page), pages.main_path(*pages.read(page))).split("\n")
    for top in ("article", "div class=post", "section"):
        got = main(f"<body><{top}><h1>Title</h1><div class=lead><p>{lead}</div><div class=body><p>{body}</div></{top.split()[0]}><div>Home</div>")
        assert got == ["Title", lead.strip(), body.strip()]
        assert main(f"<body><{top}><h1>Title</h1><p>{lead}<ul>{item * 40}</ul></{top.split()[0]}>") == ["Title", lead.strip()] + ["an item of the list"] * 40
    assert main(f"<p>{lead}</p><div>{body}</div>") == [lead.strip(), body.strip()]
    assert pages.main_path(pages.blocks(f"<body><div><ul>{item}</ul></div>")) == "body/div"


def test_wrappers_are_no_furniture():
    text = "The text of the page, of some length. " * 5
    main = lambda page: pages.text_under(pages.blocks(page), pages.main_path(*pages.read(page)))
    for name in ("overflow-hidden", "layout sidebar-right", "page-sidebar-left", "page-header-fixed", "share-enabled", "entry-related", "sidebar", "hidden"):
        for inner in ("article", "main", "h1", "div"):
            got = main(f"<body><div class='{name}'><{inner}><p>{text}</{inner}></div><div class=sidebar>Some other words</div>")
            # Two boxes of like names that hold no heading: which is the article nobody can tell, so nothing is lost.
            assert got == text.strip() or inner == "div" and got.startswith(text.strip())
    assert main(f"<body><form id=aspnetForm><div class=nav-menu>A few words</div><div><p>{text}</div><form></body>") == text.strip()
    assert main(f"<body style='display: none'><div title='hidden search' data-role=menu><p>{text}</div>") == text.strip()
    assert main("<body>" + "".join(f"<div class={x}>Some words here.</div>" for x in ("share", "related", "banner"))) == "\n".join(["Some words here."] * 3)
    kept = f"<article><p>{text}</article>"
    for name in ("cookie-notice", "sidebar-right", "related-posts", "siteHeader", "ad3", "comment-list"):
        assert main(f"<body>{kept}<div class={name}>{text * 3}</div>") == text.strip()
    few = "Words of a box that stands in between."
    for name in ("overflow-hidden", "share-enabled", "entry-related", "no-ads", "has-sidebar"):
        assert few in main(f"<body><article><p>{text}<div class={name}>{few}</div></article>")


def test_furniture_never_comes_out(frame):
    """However long it is, and whatever words stand beside its name."""
    long, text = "<p>A reader's remark that goes on and on for a while.</p>" * 12, "The article says a few things. " * 2
    story = f"<h1>T</h1><p>{text}</p>"
    names = ("comments", "user-comments", "reader-comments", "comment-thread", "comments-app", "fb-comments", "cookie-law", "cookie-consent", "google-ad",
             "ad-placeholder", "related-articles", "author-bio", "newsletter-box", "commentList")
    shown = [f"<body><article>{story}<section class={x}>{long}</section></article>" for x in names]
    shown += [f"<body><div class=post>{story}</div><div class={x}>{long}</div>" for x in names]
    shown += [f"<body><div class=post>{story}</div><div id={x}>{long}</div>" for x in names]
    shown += [f"<body><{x}>{long}</{x}><article>{story}</article>" for x in ("footer", "nav", "aside", "form", "header")]
    shown += [f"<body><div id=c class=comments><article><p>{text}</p></article>{long}</div><article>{story}</article>"]
    assert [t for t in (pages.main_text(x, None, []) for x in shown) if t != f"T\n{text.strip()}"] == []


def test_no_block_of_the_article_is_lost():
    got = lambda page: pages.main_text(page, None, []).split("\n")
    words = "Some words of the text that go on."
    assert got(f"<div class=a><p>{words}<p>{words}</div><div class=b><p>Fin.</div>") == [words, words, "Fin."]
    assert got(f"<div class=a><p>{words}<p>{words}</div><div class=b><p><a href=x>Read it all there.</a></div>") == [words, words, "Read it all there."]
    assert got(f"<article><p>{words}<p>so <math><mi>e</mi><mo>=</mo><mn>2.718</mn></math> holds</article>") == [words, "so e=2.718 holds"]


def generated(rng, kind, comments):
    """A page and its article, in one of three layouts, with reader comments in a container that no list knows."""
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + "."
    lead, paragraphs = say(8), [say(rng.randint(6, 40)) for _ in range(rng.randint(2, 6))]
    items = [say(rng.randint(10, 60)) for _ in range(comments)]
    talk = "<div class='voices'>" + "".join(f"<div class=voice><b>{say(1)}</b><p>{x}</p></div>" for x in items) + "</div>"
    body = "".join(f"<p>{x}</p>" for x in paragraphs)
    main = {"plain": f"<div class=story><h1>Head</h1><p>{lead}</p>{body}</div>", "split": f"<div class=top><h1>Head</h1><p>{lead}</p></div><div class=story>{body}</div>",
            "article": f"<article><h1>Head</h1><p>{lead}</p><div class=text>{body}</div></article>"}[kind]
    page = (f"<html><body><nav><a href=/>Home</a></nav><div class='cookie-law'>{say(30)}</div><div class=page>{main}{talk if comments else ''}</div>"
            f"<footer>{say(60)}</footer></body></html>")
    return page, "\n".join(["Head", lead, *paragraphs])


@pytest.mark.parametrize("kind", ["plain", "split", "article"])
def test_generated_pages(frame, kind):
    rng = random.Random(len(kind))
    made = [generated(rng, kind, comments) for comments in [0] * 3 + [2] * 9 + [20, 25]]
    df = frame("page_id long, url string, html string", *[(i, f"http://h.net/{i}", page) for i, (page, _) in enumerate(made)])
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(df).collect()}
    assert got == {i: text for i, (_, text) in enumerate(made)}


def test_the_vote_decides(frame):
    """A page whose comments are longer than its article is read by what the other pages of its host have settled."""
    rng = random.Random(1)
    made = [generated(rng, "plain", 2) for _ in range(6)] + [generated(rng, "plain", 30)]
    alone = pages.main_text(made[-1][0], None, [])
    assert alone != made[-1][1] and made[-1][1] in alone
    df = frame("page_id long, url string, html string", *[(i, "http://h.net/", page) for i, (page, _) in enumerate(made)])
    assert {r["page_id"]: r["text"] for r in pages.extract_pages(df).collect()}[6] == made[-1][1]


def test_consensus(frame):
    body = "<html><body><div class='{}'><p>{}</p></div><div class='extra'><p>{}</p></div></body></html>"
    usual = [(i, f"http://H.net/{i}", body.format("text12", "main text of this page " * 8, "short")) for i in range(5)]
    odd = (9, "https://h.net:80/odd", body.format("text7", "brief main", "a long list of other things " * 20))
    rows = usual + [odd, (10, "http://other.net/", PAGE), (11, None, None), (12, "http://h.net/", ""), (12, "http://h.net/", "")]
    df = frame("page_id long, url string, html string, host string, path string", *[(*r, "x", "y") for r in rows])
    got = {r["page_id"]: r for r in pages.extract_pages(df).collect()}
    assert got[9]["text"] == "brief main" and got[0]["text"] == ("main text of this page " * 8).strip()
    assert got[10]["n_chars"] == len(got[10]["text"]) > 20 and got[11]["text"] == got[12]["text"] == ""
    assert pages.extract_pages(df).count() == len(rows) and pages.extract_pages(df.limit(0)).isEmpty()
    assert html.unescape("&eacute;") in got[10]["text"]


def test_pages_of_another_layout_are_whole(frame):
    story, note = "A story in whole sentences. " * 9, "A note in the usual place."
    usual = [(i, f"http://h/{i}", f"<body><article><p>{story}</article><div class=extra><a href=/>all the links</a></div>") for i in range(5)]
    odd = [(7, f"<body><article><p>{note}</article><div class=page><p>{story}</div>"), (8, f"<body><article><p>{note}</article><div><p>{story}</div>"),
           (9, f"<body><p>{story}<article><p>{note}</article><div class=extra><p>Now some words of it.</div>")]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(frame("page_id long, url string, html string", *usual, *[(i, "http://h/x", x) for i, x in odd])).collect()}
    assert got[0] == story.strip() and got[7] == got[8] == note + "\n" + story.strip() and got[9] == story.strip() + "\n" + note


# --- mixing ----------------------------------------------------------------------------------------

def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        total = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / total >= most * sizes[s]]
        if not over:
            return target | {s: left * w[s] / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
        left -= sum(target[s] for s in over)
        free -= set(over)
    return target


@pytest.mark.parametrize("buckets", [mixing.BUCKETS, 1, 7])
def test_mixing(documents, buckets):
    rng = random.Random(8)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["a", "a", "a", "é", "Z", "b", "c", None])) for i in range(400)]
    rows += [(500, None, "a"), (501, "", "empty"), (502, "word " * 3000, "d"), (3, rows[3][1], rows[3][2]), (None, "x y", "b")]
    docs = documents(*rows)
    got = mixing.mix_sources(docs, buckets=buckets, keep=("source", "size", "block")).collect()
    assert len(got) == len(rows) and {r["block"] for r in got} == {"b"}
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    want = brute_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["size"] == 0 or r["taken"] % r["size"] == 0
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix_sources(docs, buckets=buckets)
    assert sorted((r["doc_id"] or -1, r["taken"]) for r in again.collect()) == sorted((r["doc_id"] or -1, r["taken"]) for r in got)
    assert mixing.mix_sources(docs.limit(0)).isEmpty()


def test_samples_are_bounded(documents, frame):
    rows, marks = labelled(120)
    marked = frame("doc_id long, quality int, toxic int", *marks)
    sample = labels.training_sample(documents(*rows), marked, "toxic", 20)
    assert sample.count() == 20 and sample.columns == ["text", "y"]
