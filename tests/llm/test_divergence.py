"""Divergence rules against SQL and brute force."""
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sitelode.llm import divergence as D
from sitelode.llm.oracles import ORACLES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, vote string, votes string, digest string, total string"
COUNTS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def texts():
    rng = random.Random(11)
    common = "the of and to in a is that it was for on are with as".split()
    rare = ["".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(3, 9))) for _ in range(900)]
    draw = lambda n: " ".join(rng.choice(common) if rng.random() < 0.45 else rng.choice(rare) for _ in range(n)).capitalize() + "."
    rows = [(i, draw(rng.randint(5, 400)), "en") for i in range(120)]
    rows += [(200 + i, draw(120).replace(" ", "### ").upper(), "en") for i in range(8)]
    rows += [(220 + i, " ".join(rng.choice(rare) for _ in range(150)), "en") for i in range(4)]
    rows += [(300 + i, rows[0][1], "en") for i in range(60)]  # one text holds a third of the rows
    rows += [(400 + i, draw(60).replace("a", "é"), "fr") for i in range(6)]  # too few for a class reference
    rows += [(500 + i, draw(90), None) for i in range(25)]
    rows += [(600, None, None), (601, "", "en"), (602, " \n\t ", "en"), (603, "spam " * 300, "en"), (604, "a b c d e f g h i j " * 2, "en"),
             (605, draw(40) + "\n\n" + "one line\n" * 3 + "one line ", "en"), (606, "x" * 5000, "en"), (607, "a\x0bb\x0cc\rd\x1ce\x85f g h i j k l", "en"),
             (608, "漢字 😀 ж ÿ Ā " * 60, "zh"), (None, draw(100), "en"), (5, draw(100), "en"), (5, draw(100), "en")]
    return rows


@pytest.fixture
def documents(frame):
    return lambda rows: frame(SCHEMA, *[(i, t, lang, "s", 1, "v", "w", "d", "t") for i, t, lang in rows])


def test_verdicts_against_sql(documents, values):
    rows = texts()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "lang": [r[2] for r in rows]}))
    want = sorted(con.execute(ORACLES["op11_quality_rules"]).fetchall(), key=repr)
    got = values(D.judge(documents(rows)), *COUNTS, "kept")
    assert got == want
    kept = {r[0]: r[-1] for r in got}
    assert all(r[-1] or r[6] for r in got if r[0] is not None and r[0] < 120)
    assert not any(kept[i] for i in range(200, 208)) and not any(kept[i] for i in range(220, 224)) and not kept[603]
    assert all(kept[300 + i] for i in range(60))


def test_counts_against_brute_force(documents, values):
    got = {r[0]: r for r in values(D.judge(documents([r for r in texts() if r[0] not in (None, 5)])), *COUNTS)}
    for i, text, _ in texts():
        if i in (None, 5):
            continue
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = [tuple(words[j:j + 5]) for j in range(len(words) - 4)]
        often = Counter(grams)
        hit = {j + k for j, g in enumerate(grams) if often[g] > 1 for k in range(5)}
        failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
        assert got[i] == (i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def test_pieces_of_long_texts(monkeypatch):
    rng = random.Random(3)
    long = " ".join(rng.choice(["ab", "cd", "é", "longer\nword", "x" * 90]) for _ in range(3000))
    whole = D.measure(pa.array([long, None, "", "y" * 500]))
    monkeypatch.setattr(D, "PIECE", 64)
    cut = D.measure(pa.array([long, None, "", "y" * 500]))
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))


def test_divergence():
    q = np.array([4.0, 0, 4])
    assert D.divergence(np.array([[2.0, 0, 2], [0, 9, 0], [0, 0, 0]]), q).tolist() == [0, 1, 0]
    p, m = np.array([.25, .25, .5]), np.array([.375, .125, .5])
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b) if x)
    assert D.divergence(np.array([[1.0, 1, 2]]), q)[0] == pytest.approx(math.sqrt((kl(p, m) + kl(q / 8, m)) / 2))


def test_no_rows(documents):
    assert D.judge(documents(texts()).limit(0)).isEmpty()
    only = D.judge(documents([(1, None, None)])).collect()
    assert len(only) == 1 and not only[0]["kept"] and only[0]["class_distance"] is None
