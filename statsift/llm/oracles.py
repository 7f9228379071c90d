"""DuckDB SQL for the queries that SQL can express over small tables."""

from __future__ import annotations

from statsift.llm.licenses import BASE, OWN, Template

OP1 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i, unnest(list_transform(range(0, greatest(length(h) // 2 - 99, 0)), lambda i: md5(substr(h, 2 * i + 1, 200)))) AS m FROM d),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY m ORDER BY doc_id, i) AS nth FROM w),
r AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS prev FROM n WHERE nth > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i <= prev + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
s AS (SELECT doc_id, min(i) AS low, max(i) + 100 AS high FROM g GROUP BY doc_id, run),
p AS (SELECT *, lag(high, 1, 0) OVER (PARTITION BY doc_id ORDER BY low) AS start FROM s),
k AS (SELECT p.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (low - start)), '' ORDER BY low) || substr(any_value(h), 2 * max(high) + 1) AS kept, sum(high - low) AS removed, count(*) AS spans
    FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""

OP3 = r"""WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END AS l FROM t),
s AS (SELECT DISTINCT doc_id, unnest(l) AS g FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(a, b) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""


def _list(text: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in text.split()) + "]"


def op4(base: tuple[Template, ...] = BASE, own: tuple[Template, ...] = OWN) -> str:
    """The license scan: places of key phrases, labels, and the share by IDF of what stands around them."""
    templates = (*base, *own)
    vocabulary = sorted({w for t in templates for w in t.notice.split()})
    words = ", ".join(f"('{w}')" for w in vocabulary)
    places = ", ".join(f"list_filter(range(0, len(w) - {len(t.key.split()) - 1}), lambda i: w[i + 1:i + {len(t.key.split())}] = {_list(t.key)}) AS p{k}" for k, t in enumerate(templates))
    firsts = " || ".join(f"p{k}" for k in range(len(base)))

    def labels(n: int) -> str:
        got = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{t.label}' END" for k, t in enumerate(templates[:n]))
        return f"array_to_string(list_sort(list_distinct(list_filter([{got}], lambda x: x IS NOT NULL))), ',')"

    def share(k: int, t: Template) -> str:
        weights = " + ".join(f"greatest(idf['{w}'], 0.01)" for w in t.notice.split())
        terms = " + ".join(f"CASE WHEN s + {i - t.key_at} >= 0 AND w[s + {i - t.key_at + 1}] = '{x}' THEN greatest(idf['{x}'], 0.01) ELSE 0 END" for i, x in enumerate(t.notice.split()))
        return f"coalesce(list_max(list_transform(p{k}, lambda s: ({terms}) / ({weights}))), 0)"

    score = ", ".join(share(k, t) for k, t in enumerate(templates))
    return rf"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
v(word) AS (VALUES {words}), f AS (SELECT word, (SELECT count(*) FROM t WHERE list_contains(w, word)) AS n FROM v),
i AS (SELECT map(list(word), list(ln(((SELECT count(*) FROM t) + 1) / (n + 1)))) AS idf FROM f),
p AS (SELECT doc_id, w, {places} FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len({firsts}) AS BIGINT) AS n_base, list_min({firsts}) AS first_word, list_max({firsts}) AS last_word,
    {labels(len(base))} AS base_labels, {labels(len(templates))} AS labels, round(least(1.0, greatest({score})), 6) AS score FROM p, i"""


def op11(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """Clustering with every distance in full; a round is two tables."""
    start = f"""WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND list_count(embedding) = {dims} AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false)),
c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS k, v AS c FROM v ORDER BY sha256('3:' || vec_id) LIMIT {k})"""
    steps = [start]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(k, d * {k} + k) AS k, min(d) AS d
    FROM (SELECT vec_id, v, k, CAST(list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""s{i} AS (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {dims + 1}) AS r(i) GROUP BY k, i),
c{i + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{i} LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{i} GROUP BY k) USING (k))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (k)"""


OP12 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE list_count(embedding) = len(embedding) AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false)),
p AS (SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, 65), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
    FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p QUALIFY rank <= 20"""

OP13 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS t, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(t[1:a], '') AS pre, array_to_string(t[a + 1:b], '') AS mid, array_to_string(t[b + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""

ORACLES = {"op1_suffix_dedup": OP1, "op3_minhash_near_dedup": OP3, "op4_license_scan": op4(), "op11_centroid_clustering": op11(), "op12_exact_top_k": OP12, "op13_fill_in_middle": OP13}
