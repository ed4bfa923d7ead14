"""The same results in DuckDB's SQL, for the operators that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
      ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP4 = rf"""
WITH d AS (SELECT doc_id, source, xx, size, (('0x' || substr(md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(xx, ''))), 1, 13))::BIGINT::DOUBLE + 0.5)
      / 4503599627370496.0 AS u FROM (SELECT doc_id, source, text AS xx, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM k
      WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap / w <= level THEN cap ELSE
      least(cap, w * (SELECT arg_min(level, cap / w) FROM l WHERE cap / w > level)) END AS target FROM l),
x AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
y AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest, floor(sqrt(size))::BIGINT + 1 AS w FROM x),
b AS (SELECT source, w, sum(size)::DOUBLE AS s, max(rest) AS rest FROM y GROUP BY source, w),
g AS (SELECT source, w, coalesce((rest - coalesce(sum(s) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / nullif(sum(s * w) OVER (PARTITION BY source ORDER BY w ROWS UNBOUNDED PRECEDING), 0), 0) AS c FROM b),
i AS (SELECT source, arg_max(c, w) AS c, max(w) AS top FROM g WHERE c * w < 1 GROUP BY source),
o AS (SELECT y.*, CASE WHEN w > top THEN -1 WHEN c > 0 THEN u / (1 - u) / (c * w / (1 - c * w)) ELSE u / (1 - u) END AS place
      FROM y LEFT JOIN i ON y.source IS NOT DISTINCT FROM i.source),
z AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND before + size / 2.0 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM z"""

ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP6 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, {ALNUM}) AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: w[i:i + least(len(w), 10) - 1])) AS g
      FROM b WHERE len(w) > 0),
q AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
h AS (SELECT doc_id, i, q.n, item FROM q JOIN p ON p.n = q.n AND p.g = q.w[i:i + q.n - 1]),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, LATERAL (SELECT unnest(range(0, n)) AS j) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""

_COUNT = "len({0}) - len(translate({0}, '{1}', ''))"
BOILERPLATE = ("all rights reserved|privacy policy|terms of use|terms of service|licensed under|released under|copyright|cookie|javascript|"
               "sign in|log in|subscribe|click here|read more|skip to content").split("|")
_SAID = " + ".join(f"(strlen(low) - strlen(replace(low, '{x}', ''))) / {len(x)} * {x.count(' ') + 1}" for x in BOILERPLATE)
OP9 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(x, chr(10)) AS ls FROM d), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
f AS (SELECT *, lower(line) AS low, {_COUNT.format('line', ' ')} + 1 AS n, {_COUNT.format('line', '|>»•·')} AS bars FROM l),
j AS (SELECT *, (bars >= 2 AND bars * 5 >= n) OR ({_COUNT.format('line', '#*$%&|<>{}[]=~^') } + len(line) - len(replace(line, '\', ''))) * 4 > n + 4
      OR (NOT regexp_matches(line, '\p{{Ll}}') AND regexp_matches(line, '\p{{Lu}}') AND n >= 3)
      OR (NOT regexp_matches(line, '[.,;:!?…]') AND n >= 12)
      OR (regexp_matches(low, '{'|'.join(BOILERPLATE)}') AND ({_SAID}) * 20 >= n) AS fails FROM f),
k AS (SELECT doc_id, sum(CASE WHEN fails THEN 0 ELSE len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) END) AS rest,
      count(*) FILTER (WHERE regexp_matches(line, {WORDS})) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, {WORDS})) AS dup FROM j GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS i)),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
v AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      (len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, rest
      FROM d JOIN k USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (word_chars = 0 OR 1 - rest::DOUBLE / word_chars <= 0.65) AS kept FROM v"""

OP3 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(x)::BIGINT AS n, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
       substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM d"""

# the usual reflected polynomial; acc = (acc >> 8) xor table[(acc xor byte) mod 256], both ends inverted
CRC = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))"""
# of a text without symbols above U+00FF
CRC32 = ("xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split({0}, ''), "
         "lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)), "
         "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))")

OP11 = rf"""
WITH RECURSIVE {CRC},
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
u AS (SELECT doc_id, {LOWER.replace("coalesce(text, '')", "w")} AS w, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT w, n, {CRC32.format("coalesce(doc_id::VARCHAR, '') || ':' || w")} AS h FROM u, crc WHERE length(w) >= 7),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word FROM h)
      WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, k, substr(word, 1, k::INT) || substr(word, k::INT + 2) AS s FROM v, LATERAL (SELECT unnest(range(length(word))) AS k)),
p AS (SELECT a.word, b.word AS near, b.n FROM d a JOIN d b ON a.k = b.k AND a.s = b.s AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.s UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.s),
b AS (SELECT word, count(*) AS n_near, max(n) AS top FROM p GROUP BY word),
f AS (SELECT v.word, min(p.near) AS form, min(p.n) AS form_n FROM v JOIN b USING (word) JOIN p ON p.word = v.word AND p.n = b.top AND p.n >= 10 * v.n GROUP BY v.word),
c AS (SELECT word, word AS root, 0 AS i FROM v UNION ALL SELECT c.word, f.form, i + 1 FROM c JOIN f ON f.word = c.root)
SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM v LEFT JOIN b USING (word) LEFT JOIN f USING (word)
JOIN (SELECT word, arg_max(root, i) AS root FROM c GROUP BY word) USING (word)"""

_VALUE = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_TREE_LEVELS = 20  # 3 ** 20 leaves a source


def _leaf_sql(text):
    return "sha256(" + " || ".join(_VALUE.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree_sql(name):
    """Nodes ``name0 (g, i, n, d)`` rise as name1, ...; ``name_path`` has what stands beside each node that is not a root."""
    rise = [f"""{name}{k + 1} AS (SELECT g, i // 3 AS i, (max(n) + 2) // 3 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE min(d) END AS d
FROM {name}{k} GROUP BY g, i // 3)""" for k in range(_TREE_LEVELS)]
    beside = " UNION ALL ".join(f"""SELECT {k} AS lev, a.g, a.i, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') || '|' ||
coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS e FROM {name}{k} a JOIN {name}{k} b ON a.g = b.g AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.g, a.i"""
                                for k in range(_TREE_LEVELS))
    return ",\n".join([*rise, f"{name}_path AS ({beside})"])


OP12 = rf"""
WITH {CRC},
x AS (SELECT doc_id, coalesce('=' || source, '-') AS g, {_leaf_sql("text")} AS leaf, {_leaf_sql("tampered")} AS found FROM
      (SELECT *, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS tampered FROM documents, crc)),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM x),
s0 AS (SELECT g, i, n, leaf AS d FROM o),
{_tree_sql("s")},
u AS (SELECT g, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS n FROM s{_TREE_LEVELS}),
t0 AS (SELECT '*' AS g, j AS i, n, subroot AS d FROM u),
{_tree_sql("t")},
e AS (SELECT o.g, o.i, lev, e FROM o JOIN s_path p ON p.g = o.g AND p.i = o.i // (3 ** lev)::BIGINT
      UNION ALL SELECT o.g, o.i, 100 + lev, e FROM o JOIN u USING (g) JOIN t_path p ON p.i = u.j // (3 ** lev)::BIGINT),
l AS (SELECT g, i, list(e ORDER BY lev) AS es FROM e GROUP BY g, i),
z AS (SELECT doc_id, leaf, subroot, (SELECT d FROM t{_TREE_LEVELS}) AS root, sha256(coalesce(array_to_string(list_transform(es, lambda e: replace(e, '|', '')), ''), '')) AS proof_sha256,
      list_reduce([found] || coalesce(es, []), lambda a, e: sha256(split_part(e, '|', 1) || a || split_part(e, '|', 2))) AS folded_root
      FROM o JOIN u USING (g) LEFT JOIN l ON l.g = o.g AND l.i = o.i)
SELECT *, folded_root = root AS verified FROM z"""

OP13 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
      ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

ORACLE = {
    "op3_warc_dictionary_archive": OP3,
    "op1_minhash_near_dedup": OP1, "op4_pareto_source_mix": OP4, "op6_wu_manber_decontamination": OP6, "op9_line_first_quality": OP9,
    "op11_spelling_variants": OP11, "op12_merkle_manifest": OP12, "op13_set_relation_join": OP13,
}
