"""DuckDB counterparts of the queries that SQL can express."""

from .licenses import SPELLINGS, known_texts

ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLES["op2_decontamination"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i, w FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM bw),
ns AS (SELECT DISTINCT n FROM k),
dw AS (SELECT doc_id, r, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ns WHERE len(w) >= n),
dk AS (SELECT doc_id, r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM dw),
h AS (SELECT dk.r, dk.i, dk.n, k.item_id FROM dk JOIN k ON dk.win = k.win AND dk.n = k.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""


def _canonical(column: str) -> str:
    plain = (rf"regexp_replace(lower({column}), "
             r"'(?m)^[ \t/*#;-]*(copyright|\(c\)|©)[^\n]*$', '', 'g')")
    for a, b in SPELLINGS:
        if "-" in a:
            plain = f"replace({plain}, '{a}', '{b}')"
    # A dot stays before a digit only: it is first marked, then all other dots go.
    marked = rf"regexp_replace({plain}, '\.([0-9])', chr(1) || '\1', 'g')"
    plain = rf"replace(regexp_replace({marked}, '[\x02-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), chr(1), '.')"
    return rf"regexp_replace({plain}, '  +', ' ', 'g')"


def _respelled(column: str) -> str:
    for a, b in SPELLINGS:
        if "-" not in a:
            column = rf"regexp_replace({column}, '\b{a}\b', '{b}', 'g')"
    return column


ORACLES["op3_licenses"] = f"""
WITH known(license_id, text) AS (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in known_texts())}),
k AS (SELECT min(license_id) AS license_id, {_respelled("unit")} AS unit FROM
      (SELECT license_id, trim({_canonical("text")}) AS unit FROM known) GROUP BY 2),
d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(list_transform(string_split({_canonical("coalesce(text, '')")}, chr(10)),
      lambda x: trim(x)), lambda x: x <> '') AS lines FROM documents),
u AS (SELECT r, true AS whole, array_to_string(lines, ' ') AS unit FROM d WHERE len(lines) > 0
      UNION ALL SELECT r, false, unnest(lines) FROM d),
s AS (SELECT r, whole, unit FROM u WHERE length(unit) < 200),
h AS (SELECT DISTINCT r, whole, license_id FROM (SELECT r, whole, {_respelled("unit")} AS unit FROM s) JOIN k USING (unit)),
a AS (SELECT r, bool_or(whole) AS whole, count(DISTINCT license_id) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
      FROM h GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses, coalesce(ids, '') AS licenses, coalesce(whole, false) AS whole
FROM d LEFT JOIN a USING (r)
"""

ORACLES["op7_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
n AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS c,
  sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR i = c) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""

ORACLES["op10_mixing"] = rf"""
WITH z AS (SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
d AS (SELECT doc_id, source, size,
  -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
  / CASE WHEN size > 0 THEN greatest(0.1::DOUBLE, 1 - abs(length(text)::DOUBLE / size - 6) / 10) ELSE 0.1::DOUBLE END AS key FROM z),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT source, source_size, [5.0, 2.0, 1.0][(i - 1) % 3 + 1]::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level,
  cap / w AS ratio FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, coalesce(least(cap, f.level * w), cap) AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS e FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.e, e.target - e.e * e.source_size AS rest,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (e + CASE WHEN 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""

ORACLES["op8_topk"] = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
WHERE rank <= 10
"""

_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _climb(name: str, leaves: str) -> str:
    """Levels of all trees of ``leaves`` (``tree, pos, node``), level 0 first: ``tree, level, pos, node, n``."""
    return f"""{name}(tree, level, pos, node, n) AS (
  SELECT tree, 0::BIGINT, pos::BIGINT, node, count(*) OVER (PARTITION BY tree) FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(node || coalesce(after, '')), (n + 1) // 2 FROM
    (SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY pos) AS after FROM {name}) WHERE n > 1 AND pos % 2 = 0)"""


def _paths(name: str, levels: str) -> str:
    """Every leaf's siblings from its level up: ``tree, pos, path``, of pairs (before, after)."""
    return f"""{name} AS (SELECT l.tree, l.pos, list([
    CASE WHEN (l.pos >> u.level::INT) % 2 = 1 THEN s.node ELSE '' END, CASE WHEN (l.pos >> u.level::INT) % 2 = 0 THEN coalesce(s.node, '') ELSE '' END]
    ORDER BY u.level) AS path
  FROM {levels} l JOIN {levels} u ON u.tree = l.tree AND u.pos = l.pos >> u.level::INT AND u.n > 1
  LEFT JOIN {levels} s ON s.tree = l.tree AND s.level = u.level AND s.pos = xor(u.pos, 1) WHERE l.level = 0 GROUP BY l.tree, l.pos)"""


# The checksum of the text of an id, a bit at a time.
_CRC32 = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: "
          "list_reduce([xor(a, b), 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT], "
          "lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)")

ORACLES["op13_merkle"] = f"""
WITH RECURSIVE d AS (SELECT *, coalesce('=' || lang, '') AS tree, {_leaf('n_chars')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC32.format('CAST(doc_id AS VARCHAR)')} % 7 = 0
    THEN {_leaf('(n_chars::HUGEINT + 1)')} ELSE {_leaf('n_chars')} END AS claimed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_climb('c', '(SELECT tree, pos, leaf AS node FROM p)')},
t AS (SELECT tree AS name, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM c WHERE n = 1),
{_climb('r', "(SELECT '' AS tree, place AS pos, subroot AS node FROM t)")},
{_paths('cp', 'c')}, {_paths('rp', 'r')},
a AS (SELECT p.doc_id, p.leaf, p.claimed, t.subroot, top.node AS root,
    list_concat(coalesce(cp.path, CAST([] AS VARCHAR[][])), coalesce(rp.path, CAST([] AS VARCHAR[][]))) AS path
  FROM p JOIN t ON t.name = p.tree JOIN r top ON top.n = 1 LEFT JOIN cp ON cp.tree = p.tree AND cp.pos = p.pos LEFT JOIN rp ON rp.pos = t.place)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256,
  list_reduce(list_prepend([claimed], path), lambda x, s: [sha256(s[1] || x[1] || s[2])])[1] AS folded_root, folded_root = root AS verified FROM a
"""


def _rounds(rounds: int, k: int, dims: int) -> str:
    """Assignments ``a0 .. a<rounds>`` (``r, cluster, distance``), each after one more move of the centroids ``c0 .. c<rounds>`` (``cluster, v``)."""
    steps = []
    for i in range(rounds + 1):
        if i:
            steps.append(f"""c{i} AS MATERIALIZED (SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{i - 1} c LEFT JOIN (
  SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM (SELECT cluster, j, sum(x)::BIGINT AS s, count(*) AS n FROM
    (SELECT cluster, unnest(v) AS x, unnest(range(1, {dims + 1})) AS j FROM a{i - 1} JOIN k USING (r)) GROUP BY cluster, j) GROUP BY cluster) m USING (cluster))""")
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, cluster, d AS distance FROM (SELECT k.r, c.cluster,
    list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, cluster) = 1)""")
    return ",\n".join(steps)


ORACLES["op12_centroids"] = f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS cluster, v FROM k QUALIFY cluster < 8),
{_rounds(10, 8, 64)}
SELECT k.vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM a10 JOIN k USING (r) JOIN c10 USING (cluster)
"""


# Characters of each class, in the operator's order.
_CLASSES = ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", r""".,;:!?'"()\-""", r"#*$%&|<>", None, r"\x{80}-\x{27F}", r"\x{280}-\x{7FF}",
            r"\x{800}-\x{FFFF}", r"\x{10000}-\x{10FFFF}")


def _class_counts(text: str) -> str:
    named = [c for c in _CLASSES if c]
    named = [f"length(regexp_replace({text}, {quoted(f'[^{c}]')}, '', 'g'))" if c else
             f"length(regexp_replace({text}, {quoted('[' + ''.join(named) + ']')}, '', 'g'))" for c in _CLASSES]
    return f"[{', '.join(named)}]"


def _jsd(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    bits = "CASE WHEN z[{0}] > 0 THEN z[{0}] * log2(2 * z[{0}] / (z[1] + z[2])) ELSE 0 END"
    part = "list_transform({0}, lambda x: x::DOUBLE / list_sum({0}))"
    return (f"sqrt(greatest(list_sum(list_transform(list_zip({part.format(p)}, {part.format(q)}), "
            f"lambda z: {bits.format(1)} + {bits.format(2)})) / 2, 0))")


ORACLES["op11_quality_rules"] = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS win FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
rep AS (SELECT r, count(DISTINCT spot) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS spot FROM
  (SELECT *, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1) GROUP BY r),
m AS MATERIALIZED (SELECT d.*, len(w)::BIGINT AS n_words, {_class_counts("text")} AS c, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  count(*) OVER (PARTITION BY lang, text) AS copies, count(*) OVER (PARTITION BY lang) AS rows FROM d LEFT JOIN rep USING (r)),
b AS MATERIALIZED (SELECT *, list_sum(c) - c[4] AS word_chars, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS failed,
  CASE WHEN copies > 1 AND copies * 1000 > rows THEN 1000000 // copies ELSE 1000000 END AS votes FROM m),
s AS MATERIALIZED (SELECT r, lang, votes, list_transform(c, lambda x: (x * 1048576) // list_sum(c)) AS share FROM b WHERE NOT failed AND list_sum(c) >= 200),
s1 AS (SELECT lang, list(v ORDER BY j) AS q, max(voters) AS voters FROM (SELECT lang, j, sum(x * votes) AS v, sum(votes) AS voters FROM
  (SELECT lang, votes, unnest(share) AS x, unnest(range(1, 12)) AS j FROM s) GROUP BY lang, j) GROUP BY lang HAVING max(voters) >= 20000000),
s2 AS MATERIALIZED (SELECT s.*, s1.voters, floor(1024 * {_jsd('share', 'q')}) AS bin FROM s JOIN s1 USING (lang)),
cut AS (SELECT lang, min(bin) AS cut FROM (SELECT lang, bin, voters, sum(sum(votes)) OVER (PARTITION BY lang ORDER BY bin) AS upto FROM s2
  GROUP BY lang, bin, voters) WHERE 2 * upto >= voters GROUP BY lang),
ref AS (SELECT lang, list(v ORDER BY j) AS q FROM (SELECT lang, j, sum(x * votes) AS v FROM
  (SELECT lang, votes, unnest(share) AS x, unnest(range(1, 12)) AS j FROM s2 JOIN cut USING (lang) WHERE bin <= cut) GROUP BY lang, j) GROUP BY lang),
bw AS MATERIALIZED (SELECT r, lang, votes, failed, unnest(w) AS word FROM b),
tot AS (SELECT lang, sum(votes) AS total FROM bw WHERE NOT failed GROUP BY lang),
com AS MATERIALIZED (SELECT lang, word, v, total FROM (SELECT lang, word, sum(votes) AS v FROM bw WHERE NOT failed AND strlen(word) <= 64 GROUP BY lang, word)
  JOIN tot USING (lang) WHERE v * 500 >= total),
seen AS (SELECT r, word, count(*) AS n FROM bw GROUP BY r, word),
pair AS (SELECT b.r, com.word, com.v::DOUBLE AS v, coalesce(seen.n, 0) AS n FROM b JOIN com USING (lang) LEFT JOIN seen ON seen.r = b.r AND seen.word = com.word),
other AS (SELECT b.r, NULL AS word, t.total - t.v AS v, b.n_words - coalesce(p.n, 0) AS n FROM b JOIN
  (SELECT lang, max(total) AS total, sum(v) AS v FROM com GROUP BY lang) t USING (lang) LEFT JOIN (SELECT r, sum(n) AS n FROM pair GROUP BY r) p ON p.r = b.r),
hist AS (SELECT r, list(n ORDER BY word) AS p, list(v ORDER BY word) AS q FROM (SELECT * FROM pair UNION ALL SELECT * FROM other) GROUP BY r),
j AS (SELECT b.*, CASE WHEN ref.q IS NOT NULL AND list_sum(c) > 0 THEN {_jsd('c', 'ref.q')} END AS cd, CASE WHEN n_words > 0 AND hist.q IS NOT NULL THEN {_jsd('hist.p', 'hist.q')} END AS wd
  FROM b LEFT JOIN ref USING (lang) LEFT JOIN hist USING (r))
SELECT doc_id, n_words, word_chars::BIGINT AS word_chars, c[6]::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words,
  failed AS base_failed, NOT failed AND NOT coalesce(word_chars >= 200 AND cd > 0.3, false)
  AND NOT coalesce(n_words >= 40 AND wd > 0.34 * sqrt(greatest(1, 100.0 / n_words)), false) AS kept FROM j
"""
