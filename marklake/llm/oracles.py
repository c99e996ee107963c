"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, chr(10) || coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         ([5.0::DOUBLE, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s),
f AS (
  SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size,
         CASE WHEN cap <= level * weight THEN cap
              ELSE weight * first_value(level) OVER (PARTITION BY cap <= level * weight ORDER BY cap / weight, source NULLS LAST) END AS target
  FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM t),
b AS (SELECT *, target - whole * source_size AS budget FROM p),
c AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN cum <= budget OR (cum - own <= budget AND (budget - cum + own) * 2 > own) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""

OP3 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM r
"""

def _license_sql() -> str:
    """The scan in SQL: the same templates, k-grams compared as text."""
    from .licenses import BASE, K, TEMPLATES

    rows = []
    for number, (label, phrase) in enumerate((*BASE, *TEMPLATES)):
        ws = phrase.split(" ")
        base = "true" if number < len(BASE) else "false"
        rows += [f"('{' '.join(ws[i : i + K])}', {number}, '{label}', {base}, {len(ws) - K + 1}, {len(ws)}, {i})" for i in range(len(ws) - K + 1)]
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH t(gram, template, label, is_base, n_grams, n_words_t, t_pos) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({low}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT rid, ws, unnest(range(len(ws) - 2)) AS pos FROM d WHERE len(ws) >= 3),
h AS (SELECT p.rid, t.*, p.pos, p.pos - t.t_pos AS diag FROM p JOIN t ON t.gram = ws[pos + 1] || ' ' || ws[pos + 2] || ' ' || ws[pos + 3]),
g AS (SELECT rid, template, label, is_base, n_grams, n_words_t, diag, list(DISTINCT t_pos) AS ts, min(pos) AS lo, max(pos) AS hi FROM h GROUP BY ALL),
m AS (SELECT *, sum(CASE WHEN prev IS NULL OR is_base OR diag - prev > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diag) AS grp
      FROM (SELECT *, lag(diag) OVER (PARTITION BY rid, template ORDER BY diag) AS prev FROM g)),
s AS (SELECT rid, template, label, is_base, n_grams, n_words_t, grp, len(list_distinct(flatten(list(ts)))) AS votes, min(lo) AS lo, max(hi) + 3 AS hi, min(diag) AS diag, max(len(ts)::DOUBLE / n_grams) AS one FROM m GROUP BY ALL),
f AS (SELECT *, is_base AND votes = n_grams AS whole, NOT is_base AND (votes::DOUBLE / n_grams >= 0.6 AND hi - lo <= n_words_t * 1.5 + 3 OR one >= 0.6) AS fits FROM s)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(d.ws))::BIGINT AS n_words, count(*) FILTER (whole) AS n_base,
       min(diag) FILTER (whole) AS first_word, max(diag) FILTER (whole) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole OR fits), '') AS labels,
       coalesce(max(votes::DOUBLE / n_grams) FILTER (whole OR NOT is_base), 0) AS score
FROM d LEFT JOIN f USING (rid) GROUP BY rid
"""


# Unigram features by crc32 of their bytes (the table is made by its rule), gains by bucket, noise by document.
OP12 = r"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t),
d AS (SELECT 0 AS side, row_number() OVER () AS rid, doc_id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
w AS (SELECT side, rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT side, rid, word, count(*) AS n FROM (SELECT side, rid, unnest(ws) AS word FROM w) GROUP BY ALL),
h AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM f)),
c AS (SELECT word, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT)), lambda a, b: xor(t[((xor(a, b) & 255) + 1)::BIGINT], a >> 8)), 4294967295::UBIGINT) % 10000 AS bucket FROM h, k),
b AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM f JOIN c USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
v AS (SELECT rid, sum(n * gain)::BIGINT AS weight FROM f JOIN c USING (word) JOIN g USING (bucket) WHERE side = 0 GROUP BY rid),
e AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE)))::BIGINT AS noise FROM w LEFT JOIN v USING (rid) WHERE side = 0),
r AS (SELECT *, weight + noise AS score, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (SELECT count(*) FROM e WHERE n_features >= 20) * 10 // 100 THEN place END AS rank FROM r
"""

OP13 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units,
  ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {"op8_license_scan": _license_sql(), "op3_warc": OP3, "op5_mixing": OP5, "op12_resampling": OP12, "op13_fill_middle": OP13}
