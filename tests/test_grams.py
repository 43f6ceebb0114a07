"""Terms found through the bit table, and level-wise counts, against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitelode.operators import grams as G
from sitelode.operators import keywords as K


def _found(tokens, terms):
    text = f" {' '.join(tokens)} "
    return {t for t in terms if f" {t} " in text}


@pytest.mark.parametrize("most_bits", [1 << 26, 64])
def test_known_grams_hold_every_term(spark, monkeypatch, most_bits):
    # A table of 64 bits is full: all n-grams of the lengths pass it, and no term is lost.
    monkeypatch.setattr(G, "MOST_BITS", most_bits)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["of", "the"] * 10
    pages = [("ab"[i % 2], f"u{i}", [rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200]))]) for i in range(40)]
    pages.append((None, "null", ["w1", "of"]))
    pages.append(("a", "empty", None))
    terms = {(s, " ".join(rng.choice(words) for _ in range(n))) for s in "ab" for n in (1, 2, 3, 5) for _ in range(30)}
    # Long terms that occur, at the end of a page too, and one that does not.
    long = [(s, " ".join(t[-60:])) for s, _, t in pages if t and len(t) == 200][:3]
    terms |= set(long) | {("a", " ".join(["of"] * 60))}
    keys = spark.createDataFrame(sorted(terms), "site string, term string")
    df = spark.createDataFrame(pages, "site string, url string, t array<string>")
    got = G.known_grams(df, "t", keys, "term", ["site"])
    assert got.columns == ["site", "url", "term"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    want = {(s, u, x) for s, u, t in pages if s and t for x in _found(t, {x for k, x in terms if k == s})}
    assert want and want == {r for r in rows if (r[0], r[2]) in terms}
    if most_bits > 64:
        # At 16 bits a mark, fewer than one n-gram in ten that is no term comes out.
        grams = sum(len({tuple(t[i:i + n]) for n in (1, 2, 3, 5) for i in range(len(t) - n + 1)}) for s, _, t in pages if s and t)
        assert len(rows) - len(want) < grams / 10


def test_no_row_carries_the_bit_table_and_grams_are_made_once(spark):
    df = spark.createDataFrame([("a", ["x", "y"])], "site string, t array<string>")
    keys = spark.createDataFrame([("a", "x y")], "site string, term string")
    plan = G.known_grams(df, "t", keys, "term", ["site"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" not in plan and "Join Cross" not in plan and "slice(" not in plan
    (made,) = [line for line in plan.splitlines() if "scalar-subquery" in line]
    assert "transform(" in made


def test_known_grams_without_terms(spark):
    df = spark.createDataFrame([("u", ["a"])], "url string, t array<string>")
    none = spark.createDataFrame([], "term string")
    got = G.known_grams(df, "t", none, "term")
    assert got.columns == ["url", "term"] and got.count() == 0
    assert G.known_grams(df.limit(0), "t", spark.createDataFrame([("a",)], "term string"), "term").count() == 0


@pytest.mark.parametrize("most_bits", [1 << 26, 64])
def test_frequent_terms_against_brute_force(spark, monkeypatch, most_bits):
    monkeypatch.setattr(G, "MOST_BITS", most_bits)
    rng = random.Random(7)
    words = ["alpha", "beta", "the", "of"]
    pages = [("ab"[i % 2], f"u{i}", " ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 30, 60])))) for i in range(30)]
    pages += [("a", "null", None), (None, "no site", "alpha beta")]
    df = spark.createDataFrame(pages, "site_id string, url string, text_content string")
    counts = Counter()
    for s, _, text in pages:
        t = (text or "").split()
        counts.update({(s, " ".join(t[i:i + n])) for n in (1, 2, 3) for i in range(len(t) - n + 1)
                       if not {t[i], t[i + n - 1]} & {"the", "of"}})
    got = {(r["site_id"], r["term"]): r["volume"] for r in K.candidate_terms(df, min_volume=4).collect()}
    assert got == {k: c for k, c in counts.items() if c >= 4}
    assert any(" the " in x for _, x in got)
    pairs = {r["term"] for r in K.candidate_terms(df, (2, 2), min_volume=4).collect()}
    assert pairs == {x for _, x in got if len(x.split()) == 2}


def test_table_of_marks_is_bounded(spark):
    assert G.table_bits(0) == G.table_bits(1) == 1024
    assert G.table_bits(1 << 40) == G.MOST_BITS == 8 * 8 * 1024 * 1024
    marks = spark.range(50).select(F.xxhash64("id").alias("mark"))
    table = G.mark_table(marks, 1024)
    row = table.collect()
    assert len(row) == 1 and len(row[0]["words"]) == 16
    seen = spark.range(2000).join(F.broadcast(table)).filter(F.expr(G.is_marked("words", "xxhash64(id)", 1024)))
    ids = {r["id"] for r in seen.select("id").collect()}
    assert set(range(50)) <= ids and len(ids) < 300


def test_terms_are_dealt_before_they_are_counted(spark, frame, monkeypatch):
    """Terms go to as many partitions as the texts ask for, and no task counts them before that; counts as by brute force."""
    monkeypatch.setattr(K, "TERM_CHARS", 100, raising=False)
    rng = random.Random(3)
    pages = [(rng.choice(["a", "b", None]), f"u{i % 30}", " ".join(rng.choice(["x", "Y,", "z", "the", "of"]) for _ in range(rng.choice([0, 1, 2, 40]))))
             for i in range(60)] + [("a", "u", None)]
    df = K.candidate_terms(frame("site_id string, url string, text_content string", *pages))
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("Aggregate") < plan.index("REPARTITION_BY_NUM") and "Aggregate" not in plan[plan.index("REPARTITION_BY_NUM"):]
    assert df.rdd.getNumPartitions() > 8
    want = Counter()
    for site, _, text in pages:
        words = [w.strip(",").lower() for w in (text or "").split()]
        grams = {tuple(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
        want.update((site, " ".join(g)) for g in grams if not {g[0], g[-1]} & {"the", "of"})
    assert {(r["site_id"], r["term"]): r["volume"] for r in df.collect()} == want


@pytest.mark.parametrize(("n", "stopwords"), [((1, 3), K.NOUN_STOPWORDS), ((2, 4), ())])
def test_terms_of_one_first_word_are_one_row(spark, frame, values, monkeypatch, n, stopwords):
    """What is shuffled is one row for the terms that begin at a word, not one for each; pages in large parts are dealt first; same terms."""
    monkeypatch.setattr(K, "PAGE_CHARS", 500)
    rng = random.Random(11)
    words = ["the", "of", "a+b", "é1", "x", "xy", "x.y", "+", "Z,"]
    pages = [(rng.choice(["a", "b", None]), rng.choice([f"u{i}", None]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 80])))) for i in range(20)]
    df = frame("site_id string, url string, text_content string", *pages, *pages[:5], ("a", "u", None))
    one = df.limit(1).select(F.lit("a").alias("site_id"), F.lit("u").alias("url"), F.lit("x y z the x y w x y").alias("text_content"))
    assert K.term_runs(one).count() == 6
    assert K.term_runs(df, n, stopwords).count() <= df.agg(F.sum(F.size(F.split("text_content", " ")))).first()[0]
    want = K.page_terms(df, n, stopwords).groupBy("site_id", "term").agg(F.count(F.lit(1)).alias("volume"))
    got = K.candidate_terms(df, n, stopwords)
    assert got.columns == ["site_id", "term", "volume"] and got.count() == want.count() > 10
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
