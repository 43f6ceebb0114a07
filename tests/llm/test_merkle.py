"""Merkle manifests against hashing level by level."""
import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitelode.llm import merkle, queries
from sitelode.llm.oracles import ORACLES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos long, digest string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i:i + arity]) for i in range(0, len(out[-1]), arity)])
    return out


def siblings(tree, i, arity):
    for level in tree[:-1]:
        a = i // arity * arity
        yield "".join(level[a:i]), "".join(level[i + 1:a + arity])
        i //= arity


def brute(rows, arity=2):
    langs = sorted({r[2] for r in rows}, key=lambda k: (k is not None, (k or "").encode()))
    trees, out = {}, []
    for k in langs:
        own = sorted(((leaf(r), r) for r in rows if r[2] == k), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[k] = own, levels([h for h, _ in own], arity)
    top = levels([trees[k][1][-1][0] for k in langs], arity)
    for j, k in enumerate(langs):
        for i, (h, r) in enumerate(trees[k][0]):
            path = [*siblings(trees[k][1], i, arity), *siblings(top, j, arity)]
            odd = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf((*r[:3], r[3] + 1, r[4])) if odd else h
            for before, after in path:
                node = sha(before, node, after)
            out.append((r[0], h, trees[k][1][-1][0], top[-1][0], sha(*(b + a for b, a in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, "a", "b"]), rng.choice([None, "", "en", "é", "zz", "en", "en", "en"]),
             rng.choice([None, 3, 5]), rng.choice([None, "", "x", "yy é", "long " * 300])) for _ in range(n)]
    return rows + rows[:5]


def made(frame, rows, **how):
    claimed = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(frame(SCHEMA, *[(*r, "t", 1, "d", "p") for r in rows]),
                          also={"claimed": F.when(odd & F.col("n_chars").isNotNull(), claimed)}, **how)
    folded = merkle.fold(F.col("path"), F.coalesce("claimed", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("path")).alias("p"), folded.alias("f"),
                      (folded == F.col("root")).alias("ok"))


@pytest.mark.parametrize("n,arity,height,ranges", [(120, 2, 8, 10 ** 6), (90, 2, 2, 7), (90, 3, 2, 10), (40, 4, 1, 3), (0, 2, 8, 5), (1, 2, 1, 5)])
def test_manifest(frame, values, n, arity, height, ranges):
    rows = rows_of(n, n + arity) or [(1, None, None, None, None)]
    assert values(made(frame, rows, arity=arity, levels=height, range_rows=ranges)) == brute(rows, arity)


def test_manifest_of_many_trees(frame, values):
    rows = [(i, "s", f"l{i % 9}", 4, "t") for i in range(40)]
    assert values(made(frame, rows, levels=1)) == brute(rows)


def test_no_rows_and_wrong_parameters(frame):
    empty = frame(SCHEMA, (1, "s", "en", 1, "t", "t", 1, "d", "p")).limit(0)
    assert merkle.manifest(empty).isEmpty()
    with pytest.raises(ValueError):
        merkle.manifest(empty, arity=1)


def test_query_and_sql(spark, frame, values, tmp_path):
    rows = [(i, "s", random.Random(i).choice([None, "en", "en", "é"]), i % 9 or None, f"text {i}") for i in range(70)] + [(None, None, "fr", 1, None)]
    frame("doc_id long, source string, lang string, n_chars long, text string", *rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows)
    assert values(queries.QUERIES["op13_merkle"](spark, str(tmp_path))) == want
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "source": [r[1] for r in rows], "lang": [r[2] for r in rows],
                                            "n_chars": pd.array([r[3] for r in rows], "Int64"), "text": [r[4] for r in rows]}))
    assert sorted(con.execute(ORACLES["op13_merkle"]).fetchall(), key=repr) == want
