"""DuckDB SQL for the queries of operators that SQL can express, each by a plainer path than the operator's."""

from __future__ import annotations

from .mixing import oracle_sql as _mixing

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: All pairs of documents that share a shingle, then all ids that links reach.
MINHASH = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_SPACED}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP
 BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), r(id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT id, min(other) AS m FROM r GROUP BY 1) SELECT doc_id, len(s)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM s JOIN c ON id = doc_id"""

#: Every window of every item against every run of as many words of every document.
DECONTAMINATION = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents), i AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM
 benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w)
 - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
m AS (SELECT DISTINCT m FROM g), r AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m +
 2)) AS p FROM d, m WHERE len(w) >= m)),
h AS (SELECT doc_id, item_id, p, m FROM r JOIN g USING (m, g)), n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m))
 AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id,
 item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS
 items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: All pairs of a label.
VECTORS = """WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
links AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(id, other) AS (SELECT id, id FROM v UNION SELECT r.id, l.b FROM r JOIN links l ON r.other = l.a), c AS (SELECT id, min(other) AS m FROM r GROUP BY 1), n AS
 (SELECT a, count(*) AS n FROM links GROUP BY 1)
SELECT v.id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, m AS component_id, v.id = m AS kept FROM v JOIN c USING (id) LEFT JOIN n ON n.a = v.id"""

#: Lines that share one of their rarest words, compared whole.
LINES = f"""WITH t AS (SELECT doc_id, {_FOLD} AS text FROM documents), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text,
 chr(10))))) AS l FROM t),
s AS (SELECT doc_id, l, list_sort(list_distinct(regexp_extract_all(line, '{_ALNUM}'))) AS s FROM l), u AS (SELECT s, min((doc_id, l)) AS first FROM s WHERE
 len(s) > 0 GROUP BY 1),
w AS (SELECT first, len(s) AS n, unnest(s) AS w FROM u), f AS (SELECT w, count(*) AS f FROM w GROUP BY 1), p AS (SELECT first, n, w, row_number() OVER
 (PARTITION BY first ORDER BY f, w) AS i FROM w JOIN f USING (w)),
q AS (SELECT first, n, w FROM p WHERE i <= n - ceil(0.8 * n - 1e-9) + 1),
c AS (SELECT DISTINCT b.first AS later, a.first AS earlier FROM q a JOIN q b ON a.w = b.w AND a.first < b.first AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) - 1e-9),
late AS (SELECT DISTINCT later FROM c JOIN u x ON x.first = later JOIN u y ON y.first = earlier WHERE len(list_intersect(x.s, y.s)) >= 0.8 * (len(x.s) +
 len(y.s) - len(list_intersect(x.s, y.s))) - 1e-9)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE u.s IS NOT NULL AND ((doc_id, l) <> first OR first IN (SELECT later FROM late)))::BIGINT AS
 n_removed FROM s LEFT JOIN u ON u.s = s.s GROUP BY 1"""

def _crc(x: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    steps = f"list_concat([4294967295], flatten(list_transform(range(1, length({x}) + 1), lambda i: [ascii(({x})[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"


#: Pairs of equal words at each distance, stretches of such places one after the other, and of equal stretches the least distance.
RUNS = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w, {_crc("doc_id::VARCHAR")} AS h FROM documents),
b AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM b), p AS (SELECT *, 1 + (n - a) // (3 + g %
 8) AS p FROM a),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w
 END AS w FROM p),
x AS (SELECT doc_id, n, unnest(w) AS w, unnest(range(n)) AS i FROM t), e AS (SELECT l.doc_id, r.i - l.i AS q, l.i FROM x l JOIN x r ON l.doc_id = r.doc_id AND
 l.w = r.w AND r.i > l.i AND 2 * (r.i - l.i) <= l.n),
k AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM e), s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS
 length FROM k GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM s GROUP BY 1, 2, 3),
m AS (SELECT doc_id, count(*)::BIGINT AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
 arg_min((start, length, period), (-length, start, period)) AS best FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r), c AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS c FROM x ANTI
 JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period, (1000 * best[2]::BIGINT //
 best[3]::BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM t LEFT JOIN m ON m.doc_id = t.doc_id LEFT JOIN c ON c.doc_id = t.doc_id"""


def _tree(name: str, levels: int) -> list[str]:
    """CTEs of a forest's levels over ``<name>0(s, p, h)``: groups of 16 with their digests in order, counts, and the next level."""
    parts = []
    for j in range(levels):
        parts.append(f"{name}g{j} AS (SELECT s, p // 16 AS q, list(h ORDER BY p) AS hs FROM {name}{j} GROUP BY 1, 2)")
        parts.append(f"{name}n{j} AS (SELECT s, count(*) AS n FROM {name}{j} GROUP BY 1)")
        parts.append(f"{name}{j + 1} AS (SELECT s, q AS p, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}g{j} JOIN {name}n{j} USING (s))")
    return parts


def _climb(name: str, levels: int, source: str, s: str, p: str) -> tuple[list[str], str]:
    """CTEs that carry ``folded`` and ``proof`` of each row of ``source`` up such levels; ``s`` and ``p`` name its tree and place."""
    parts, last = [], source
    for j in range(levels):
        at = f"x.{p} // {16**j} % 16"
        left, right = f"array_to_string(hs[1:{at}], '')", f"array_to_string(hs[{at} + 2:], '')"
        parts.append(f"{name}x{j} AS (SELECT x.* REPLACE (CASE WHEN n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded, proof || {left} || {right} AS proof) FROM {last} x JOIN {name}g{j} g ON g.s = x.{s} AND g.q = x.{p} // {16 ** (j + 1)} JOIN {name}n{j} n ON n.s = x.{s})")
        last = f"{name}x{j}"
    return parts, last


def _manifest_sql(levels: int = 5, above: int = 4) -> str:
    """Trees of at most 16 ** 5 leaves a source and 16 ** 4 sources."""
    f = lambda x: f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(map(f, ('doc_id', 'source', 'lang', 'n_chars', text)))})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {_crc('doc_id::VARCHAR')} % 5 = 0 THEN {leaf(low)} END AS tampered FROM documents)"]
    parts.append("o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, coalesce(tampered, leaf) AS folded, '' AS proof FROM d)")
    parts += ["a0 AS (SELECT s, p, leaf AS h FROM o)", *_tree("a", levels), f"b0 AS (SELECT 0 AS s, s AS p, h FROM a{levels})", *_tree("b", above)]
    own, last = _climb("a", levels, "o", "s", "p")
    parts += [*own, f"j AS (SELECT *, 0 AS zero FROM {last})"]
    top, last = _climb("b", above, "j", "zero", "s")
    parts += top
    return f"WITH {', '.join(parts)} SELECT x.doc_id, x.leaf, a.h AS subroot, b.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b.h AS verified FROM {last} x JOIN a{levels} a ON a.s = x.s, b{above} b"


MANIFEST = _manifest_sql()

ORACLE: dict[str, str] = {
    "op1_minhash_near_dedup": MINHASH,
    "op2_mixing": _mixing(),
    "op5_benchmark_decontamination": DECONTAMINATION,
    "op6_embedding_near_dedup": VECTORS,
    "op7_line_dedup": LINES,
    "op12_periodic_runs": RUNS,
    "op13_merkle_manifest": MANIFEST,
}
