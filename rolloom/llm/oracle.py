"""SQL of the registered queries, where SQL can say what they do."""

from __future__ import annotations

_BLANKS = "[\\x20\\x09-\\x0D]"
_WORD = "[^\\x20\\x09-\\x0D]+"

OP2 = f"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '{_BLANKS}', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT text_sha256, count(*) AS group_size,
         arg_min(doc_id, (-n_chars, doc_id)) AS keep_id
  FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, n_chars, text_sha256
FROM d JOIN g USING (text_sha256)
"""

OP3 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (
  SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000
  GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
w AS (
  SELECT vec_id, e,
         CASE WHEN len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              THEN sqrt(list_dot_product(e, e)) END AS norm
  FROM v),
u AS (SELECT vec_id, e, norm FROM w WHERE norm > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u AS a JOIN u AS b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
     AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
degree AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links
FROM w LEFT JOIN degree USING (vec_id)
"""

# ``mixed`` holds one row per document with its epochs; the query of a stage selects from it
MIX = f"""
WITH d AS (
  SELECT *, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)
           AS h
  FROM {{documents}}),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM sizes),
weighed AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap
  FROM ranked),
rest AS (
  SELECT *,
         CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS BIGINT) AS words_left,
         CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_left
  FROM weighed
  WINDOW b AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT words_left AS l_words, w_left AS l_w FROM rest WHERE words_left * w <= cap * w_left
  ORDER BY cap / w, r LIMIT 1),
plan AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), CAST(l_words * w AS DOUBLE) / l_w) AS target
  FROM rest, level),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END
           AS whole FROM plan),
room AS (SELECT *, target - whole * source_size AS extra FROM budget),
cells AS (
  SELECT source, h, sum(size) AS words FROM d WHERE size > 0 GROUP BY source, h),
upto AS (
  SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS total FROM cells),
edge AS (
  SELECT u.source, min(u.h) AS h, arg_min(u.words, u.h) AS words, arg_min(u.total, u.h) AS total,
         any_value(extra) AS extra
  FROM upto u JOIN room ON u.source IS NOT DISTINCT FROM room.source
  WHERE extra > 0 AND u.total > extra GROUP BY u.source),
cut AS (
  SELECT source,
         CASE WHEN (extra - (total - words)) * 2 >= words THEN h + 1 ELSE h END AS threshold
  FROM edge),
mixed AS (
  SELECT d.*, source_size, target,
         whole + CASE WHEN coalesce(d.h < threshold, false) THEN 1 ELSE 0 END AS epochs
  FROM d JOIN room ON d.source IS NOT DISTINCT FROM room.source
  LEFT JOIN cut ON d.source IS NOT DISTINCT FROM cut.source)
"""

OP7 = (
    MIX.format(documents="documents")
    + "SELECT doc_id, size, source_size, target, epochs, size * epochs AS taken FROM mixed"
)

_CRC_TABLE = """
crc_steps(b, k, c) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, CAST(3988292384 AS BIGINT)) ELSE c // 2 END
  FROM crc_steps WHERE k < 8),
crc_table AS (SELECT b, c FROM crc_steps WHERE k = 8)"""


def _crc(name: str, texts: str) -> str:
    """CTEs that give ``name(t, crc)``, the unsigned CRC32 of each ``t`` of the relation ``texts``."""
    return f"""
{name}_bytes(t, h, pos, c) AS (
  SELECT t, hex(encode(t)), 1, CAST(4294967295 AS BIGINT) FROM (SELECT DISTINCT t FROM {texts})
  UNION ALL
  SELECT s.t, s.h, s.pos + 2, xor(s.c // 256, x.c)
  FROM {name}_bytes AS s JOIN crc_table AS x
  ON x.b = xor(s.c % 256, CAST(('0x' || substr(s.h, s.pos, 2)) AS BIGINT))
  WHERE s.pos < length(s.h)),
{name} AS (
  SELECT t, xor(c, CAST(4294967295 AS BIGINT)) AS crc FROM {name}_bytes WHERE pos > length(h))"""


def _tree(name: str, leaves: str) -> str:
    """CTEs ``name`` (tree, level, pos, n, digest) of all nodes and ``name_beside`` of their siblings."""
    return f"""
{name}(tree, level, pos, n, digest) AS (
  SELECT tree, 0, pos, n, digest FROM {leaves}
  UNION ALL
  SELECT tree, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3),
{name}_beside AS (
  SELECT a.tree, a.level, a.pos,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} AS a JOIN {name} AS b
  ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos)"""


def _leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


OP11 = f"""
WITH RECURSIVE {_CRC_TABLE},
ids AS (SELECT CAST(doc_id AS VARCHAR) AS t FROM documents WHERE doc_id IS NOT NULL),
{_crc("id_crc", "ids")},
d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos,
         count(*) OVER (PARTITION BY source) AS n,
         {_leaf("text")} AS digest,
         CASE WHEN crc % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END
           AS claimed
  FROM documents LEFT JOIN id_crc ON t = CAST(doc_id AS VARCHAR)),
{_tree("up", "d")},
groups AS (
  SELECT 0 AS tree, tree - 1 AS pos, count(*) OVER () AS n, digest FROM up WHERE n = 1),
{_tree("top", "groups")},
low(doc_id, tree, leaf, level, pos, proof, node) AS (
  SELECT doc_id, tree, digest, 0, pos, '', claimed FROM d
  UNION ALL
  SELECT p.doc_id, p.tree, p.leaf, p.level + 1, p.pos // 3, p.proof || b.l || b.r,
         sha256(b.l || p.node || b.r)
  FROM low AS p JOIN up_beside AS b ON p.tree = b.tree AND p.level = b.level AND p.pos = b.pos),
high(doc_id, leaf, subroot, level, pos, proof, node) AS (
  SELECT p.doc_id, p.leaf, g.digest, 0, g.pos, p.proof, p.node
  FROM low AS p JOIN up AS u ON p.tree = u.tree AND p.level = u.level AND p.pos = u.pos
  JOIN groups AS g ON g.pos = p.tree - 1 WHERE u.n = 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.subroot, p.level + 1, p.pos // 3, p.proof || b.l || b.r,
         sha256(b.l || p.node || b.r)
  FROM high AS p JOIN top_beside AS b ON p.level = b.level AND p.pos = b.pos)
SELECT p.doc_id, p.leaf, p.subroot, t.digest AS root, sha256(p.proof) AS proof_sha256,
       p.node AS folded_root, p.node = t.digest AS verified
FROM high AS p JOIN top AS t ON p.level = t.level AND p.pos = t.pos AND t.n = 1
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP12 = f"""
WITH RECURSIVE {_CRC_TABLE},
texts AS (
  SELECT true AS target, row_number() OVER () AS row, CAST(NULL AS BIGINT) AS doc_id, text FROM benchmark
  UNION ALL
  SELECT false, row_number() OVER (), doc_id, text FROM documents),
words AS (
  SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'),
                               '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM texts),
features AS (
  SELECT target, row, unnest(w) AS t FROM words
  UNION ALL
  SELECT target, row,
         unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
{_crc("crcs", "features")},
hits AS (SELECT target, row, crc % 10000 AS bucket FROM features JOIN crcs USING (t)),
counts AS (
  SELECT CAST(bucket AS DOUBLE) AS bucket, CAST(count(*) FILTER (NOT target) AS DOUBLE) AS s,
         CAST(count(*) FILTER (target) AS DOUBLE) AS t
  FROM hits GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(
      ((t + 1) * ((SELECT sum(s) FROM counts) + 10000))
      / ((s + 1) * ((SELECT sum(t) FROM counts) + 10000)))) AS BIGINT) AS gain
  FROM counts),
weights AS (
  SELECT row, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS total
  FROM hits JOIN gains USING (bucket) WHERE NOT target GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0)
           AS weight,
         CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT)
           AS h
  FROM words LEFT JOIN weights USING (row) WHERE NOT target),
final AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT)
           AS score
  FROM scored),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, row) AS rank,
         count(*) OVER () * 25 // 100 AS drawn
  FROM final WHERE n_words >= 20)
SELECT doc_id, n_words, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank
FROM final LEFT JOIN ranked USING (row)
"""

OP13 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON len(q.e) = len(c.e) AND q.vec_id IS DISTINCT FROM c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# SQL has no XXH64, sub-word models, parsers of broken markup or suffix automata; links of embeddings
# can be counted but their components cannot without recursion over all pairs: tests hold those
# queries against brute force instead
ORACLE: dict[str, str] = {
    "op2_exact_dedup": OP2,
    "op3_warc": OP3,
    "op7_mixing": OP7,
    "op11_merkle": OP11,
    "op12_resampling": OP12,
    "op13_topk_search": OP13,
}
