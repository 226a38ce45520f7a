"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontamination,
    exact_dedup,
    line_dedup,
    lm_scoring,
    merkle,
    near_dedup,
    pii,
    quality,
    sentencepiece_codec,
    sharding,
    toxicity,
    turn_repair,
)
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations plus conversation -7, whose texts are control strings, and reads them back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat_format.digests(chat_format.expand(rows.unionByName(control)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in all documents."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of lines."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy differences of all documents, to six digits; the target is the documents labelled quality 1."""
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with parity against the reference library and the round trip."""
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), sentencepiece_codec.read_model())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digests(pii.find_pii(table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 contiguous shards of nearly equal bytes."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts among all documents."""
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    hurt = turn_repair.damage(table(spark, sf_dir, "conversations"))
    return turn_repair.digests(turn_repair.repair(hurt, F.col("stays")))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, a third of them tampered with, against the manifest of the originals."""
    documents = table(spark, sf_dir, "documents")
    found = merkle.proofs(merkle.build(documents, merkle.tampered(documents)))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "n_siblings")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_decontamination,
        op3_line_dedup,
        op4_lm_scoring,
        op5_sentencepiece,
        op6_near_dedup,
        op7_toxicity,
        op8_pii,
        op9_sharding,
        op10_exact_dedup,
        op11_quality,
        op12_turn_repair,
        op13_merkle,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(txt) + length(txt) - length(replace(txt, '\', ''))
            + len(regexp_extract_all(txt, '</?s>|\[/?(?:INST|ROLE)\]')) AS text_len,
         length(role) + length(role) - length(replace(role, '\', ''))
            + len(regexp_extract_all(role, '</?s>|\[/?(?:INST|ROLE)\]')) AS role_len
  FROM c),
f AS (
  SELECT *, CASE WHEN role = 'user' THEN text_len + 15 ELSE text_len + role_len + 20 END AS f_len,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, txt) AS i,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM e),
p AS (SELECT *, sum(f_len) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM f)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || txt || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(txt)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(txt, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR i = n)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR i = n)::BIGINT AS n_examples
FROM p GROUP BY conv_id""",
    "op2_decontamination": r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
b AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS content
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM dw),
hit AS (
  SELECT DISTINCT p.doc_id, p.i, b.l, b.content
  FROM (SELECT doc_id, i, l, array_to_string(w[i : i + l - 1], ' ') AS content
        FROM pos, (SELECT DISTINCT l FROM b) WHERE i + l - 1 <= len(w)) p
  JOIN (SELECT DISTINCT l, content FROM b) b ON b.l = p.l AND b.content = p.content),
n AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS j FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hit JOIN b USING (l, content) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op3_line_dedup": r"""
WITH l0 AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents),
l1 AS (SELECT doc_id, unnest(a) AS raw, generate_subscripts(a, 1) - 1 AS ln FROM l0),
l2 AS (SELECT doc_id, ln, trim(raw) AS line, len(string_split_regex(trim(raw), ' +')) AS w FROM l1 WHERE trim(raw) <> ''),
l3 AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS e FROM l2),
l4 AS (SELECT *, (e - w)::BIGINT AS s, e::BIGINT AS e2 FROM l3),
win AS (
  SELECT doc_id, 'f' AS kind, min(s) OVER fw AS s, max(e2) OVER fw AS e, min(ln) OVER fw AS a, max(ln) OVER fw AS z,
         list(line) OVER fw AS content
  FROM l4 WINDOW fw AS (PARTITION BY doc_id ORDER BY s RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
  UNION ALL
  SELECT doc_id, 'b', min(s) OVER bw, max(e2) OVER bw, min(ln) OVER bw, max(ln) OVER bw, list(line) OVER bw
  FROM l4 WINDOW bw AS (PARTITION BY doc_id ORDER BY e2 RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
ok AS (SELECT * FROM win WHERE e - s >= 50),
first AS (SELECT kind, content, min(row(doc_id, s, e)) AS f FROM ok GROUP BY kind, content),
later AS (SELECT doc_id, a, z FROM ok JOIN first USING (kind, content) WHERE doc_id <> f[1] OR s >= f[3]),
stretch AS (
  SELECT doc_id, isl, min(a) AS a, max(z) AS z FROM (
    SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM (
      SELECT ok2.*, CASE WHEN s <= max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens
      FROM (SELECT ok.doc_id, ok.a, ok.z, ok.s, ok.e FROM ok JOIN first USING (kind, content) WHERE ok.doc_id <> f[1] OR ok.s >= f[3]) ok2))
  GROUP BY doc_id, isl),
gone AS (SELECT DISTINCT doc_id, ln FROM (SELECT doc_id, unnest(range(a, z + 1)) AS ln FROM stretch)),
kept AS (
  SELECT l1.doc_id, string_agg(raw, chr(10) ORDER BY ln) FILTER (g.doc_id IS NULL) AS txt, count(*) AS n, count(g.doc_id) AS r
  FROM l1 LEFT JOIN gone g USING (doc_id, ln) GROUP BY l1.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(txt, '') END AS text,
       coalesce(n, 0)::BIGINT AS n_lines, coalesce(r, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)""",
    "op4_lm_scoring": r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
t AS (
  SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS g, unnest(list_prepend('', w[1 : len(w) - 1])) AS a, unnest(w) AS b
  FROM dw WHERE len(w) > 0),
al AS (SELECT count(*) AS n, count(*) FILTER (g) AS ng, count(DISTINCT b) AS v, count(*) FILTER (g) / greatest(1, count(*)) AS k FROM t),
wo AS (SELECT b, count(*) AS n, count(*) FILTER (g) AS ng FROM t GROUP BY b),
co AS (SELECT a, count(*) AS n, count(*) FILTER (g) AS ng FROM t GROUP BY a),
pa AS (SELECT a, b, count(*) AS n, count(*) FILTER (g) AS ng FROM t GROUP BY a, b),
own AS (
  SELECT doc_id, g, g::INT AS share, a, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS all_n, sum(count(*)) OVER (PARTITION BY doc_id, a) AS a_n,
         sum(count(*)) OVER (PARTITION BY doc_id, b) AS b_n
  FROM t GROUP BY doc_id, g, a, b),
p AS (
  SELECT doc_id, o.n AS times, all_n,
         ln((pa.ng - share * o.n + 50 * (wo.ng - share * b_n + 1) / (al.ng - share * all_n + v)) / (co.ng - share * a_n + 50)) AS target,
         ln(((pa.n - o.n) * k + 50 * ((wo.n - b_n) * k + 1) / ((al.n - all_n) * k + v)) / ((co.n - a_n) * k + 50)) AS background
  FROM own o JOIN pa USING (a, b) JOIN wo USING (b) JOIN co USING (a), al),
l AS (SELECT doc_id, -sum(times * target) / any_value(all_n) AS target, -sum(times * background) / any_value(all_n) AS background FROM p GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_tokens, round(target, 6) AS target_loss, round(background, 6) AS background_loss, round(target - background, 6) AS score
FROM dw LEFT JOIN l USING (doc_id)""",
    "op6_near_dedup": r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
runs AS (
  SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS run, count(*) AS c
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM dw WHERE len(w) > 0) GROUP BY ALL),
size AS (SELECT doc_id, sum(c) AS n FROM runs GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.c, y.c)) AS n FROM runs x JOIN runs y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common o JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE o.n >= 0.8::DOUBLE * (x.n + y.n - o.n)),
ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS root FROM dw UNION SELECT b, root FROM reach JOIN ways ON a = doc_id),
class AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY doc_id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM class""",
    "op9_sharding": r"""
WITH bits AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents),
c AS (
  SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, bits),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32) - size AS before, sum(size) OVER () AS total FROM c),
p AS (SELECT *, ((2 * before + size) * 8 // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p""",
    "op10_exact_dedup": r"""
WITH h AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op12_turn_repair": r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt,
         list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS kind FROM k, bits),
d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt, unnest(range(0, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i,
         rtrim(txt, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
f AS (
  SELECT *, left(role, 1) AS c, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, txt ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault FROM o),
g AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more,
         CASE WHEN lag(c) OVER w || c IN ('su', 'ua', 'au') OR lag(c) OVER w IS NULL THEN 0 ELSE 1 END AS illegal FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
n AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, sum(illegal)::BIGINT AS illegal, max(i) AS len FROM g GROUP BY conv_id),
-- The best (cost, audit) of what is read so far, by what comes next: 0 anything, 1 u after a lone s, 2 u or the end, 3 a.
p AS (
  SELECT conv_id, 0::BIGINT AS i, 0::BIGINT AS cost0, 1000000::BIGINT AS cost1, 0::BIGINT AS cost2, 3::BIGINT AS cost3, '' AS audit0, '' AS audit1, '' AS audit2, 'I' AS audit3 FROM n
  UNION ALL
  SELECT conv_id, i, z0.cost, z1.cost, e2.cost, e3.cost, z0.audit, z1.audit, e2.audit, e3.audit FROM (
    SELECT conv_id, i, z0, z1, least(z2, {'cost': z3.cost + 3, 'audit': z3.audit || 'I'}) AS e2,
           least(z3, {'cost': z2.cost + 3, 'audit': z2.audit || 'I'}, {'cost': z1.cost + 3, 'audit': z1.audit || 'I'}, {'cost': z0.cost + 3, 'audit': z0.audit || 'I'}) AS e3 FROM (
      SELECT p.conv_id, g.i,
             {'cost': cost0 + 4, 'audit': audit0 || 'D'} AS z0,
             least({'cost': cost1 + 4, 'audit': audit1 || 'D'}, CASE WHEN NOT gone AND c = 's' THEN {'cost': cost0 + more, 'audit': audit0 || 'K'} END) AS z1,
             least({'cost': cost2 + 4, 'audit': audit2 || 'D'}, CASE WHEN NOT gone THEN {'cost': cost3 + more + CASE WHEN c = 'a' THEN 0 ELSE 3 END, 'audit': audit3 || CASE WHEN c = 'a' THEN 'K' ELSE 'R' END} END) AS z2,
             least({'cost': cost3 + 4, 'audit': audit3 || 'D'},
                   CASE WHEN NOT gone THEN {'cost': cost0 + more + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'audit': audit0 || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END} END,
                   CASE WHEN NOT gone THEN {'cost': cost1 + more + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'audit': audit1 || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END} END,
                   CASE WHEN NOT gone THEN {'cost': cost2 + more + CASE WHEN c = 'u' THEN 0 ELSE 3 END, 'audit': audit2 || CASE WHEN c = 'u' THEN 'K' ELSE 'R' END} END) AS z3
      FROM p JOIN g ON g.conv_id IS NOT DISTINCT FROM p.conv_id AND g.i = p.i + 1))),
best AS (SELECT p.conv_id, least({'cost': cost0, 'audit': audit0}, {'cost': cost2, 'audit': audit2}) AS x FROM p JOIN n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND i = len),
edit AS (
  SELECT conv_id, unnest(string_split(x.audit, '')) AS e, unnest(range(1, len(x.audit) + 1)) AS step, len(replace(x.audit, 'D', '')) AS size FROM best WHERE x.audit <> ''),
numbered AS (
  SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, size - count(*) FILTER (e <> 'D') OVER w AS after FROM edit WINDOW w AS (PARTITION BY conv_id ORDER BY step)),
said AS (
  SELECT a.conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN after % 2 = 0 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE txt END, chr(10) ORDER BY step) AS turns
  FROM numbered a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id AND g.i = a.i WHERE e <> 'D' GROUP BY a.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(x.cost, 0) AS cost, coalesce(x.audit, '') AS audit, sha256(coalesce(turns, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_merkle": r"""
WITH RECURSIVE bits AS (SELECT list_transform(range(0, 256), lambda b: list_reduce(list_prepend(b, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
s AS (
  SELECT doc_id, lang, coalesce('=' || lang, '') AS tree,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head, text,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
         list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS b
  FROM documents),
l AS (
  SELECT doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 3 = 0
                                                                      THEN lower_text ELSE text END, '-')) AS claim FROM s, bits),
r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS total FROM l),
up AS (
  SELECT tree, 0 AS depth, pos, leaf AS node, total FROM r
  UNION ALL
  SELECT tree, depth + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM up WHERE total > 1 GROUP BY tree, depth, pos // 8),
roots AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS total FROM up WHERE total = 1),
top AS (
  SELECT 0 AS depth, pos, node, total FROM roots
  UNION ALL
  SELECT depth + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (any_value(total) + 7) // 8 FROM top WHERE total > 1 GROUP BY depth, pos // 8),
runs AS (
  SELECT tree, depth, pos // 8 AS run, list(node ORDER BY pos) AS nodes FROM up WHERE total > 1 GROUP BY ALL
  UNION ALL
  SELECT NULL, depth, pos // 8, list(node ORDER BY pos) FROM top WHERE total > 1 GROUP BY ALL),
-- Walks every leaf up its own tree, then up the tree of subroots (tree is null there).
walk AS (
  SELECT r.tree AS own, r.pos AS leaf_pos, r.tree, 0 AS depth, r.pos, claim AS node, '' AS proof FROM r
  UNION ALL
  SELECT own, leaf_pos, CASE WHEN u.nodes IS NULL THEN NULL ELSE w.tree END, CASE WHEN u.nodes IS NULL THEN 0 ELSE w.depth + 1 END, CASE WHEN u.nodes IS NULL THEN roots.pos ELSE w.pos // 8 END,
         CASE WHEN u.nodes IS NULL THEN w.node ELSE sha256(array_to_string(u.nodes[1 : w.pos % 8] || [w.node] || u.nodes[w.pos % 8 + 2 :], '')) END,
         w.proof || coalesce(array_to_string(u.nodes[1 : w.pos % 8] || u.nodes[w.pos % 8 + 2 :], ''), '')
  FROM walk w LEFT JOIN runs u ON u.tree IS NOT DISTINCT FROM w.tree AND u.depth = w.depth AND u.run = w.pos // 8 LEFT JOIN roots ON roots.tree = w.own
  WHERE w.tree IS NOT NULL OR u.nodes IS NOT NULL),
done AS (
  SELECT own, leaf_pos, node, proof FROM walk w WHERE tree IS NULL AND NOT EXISTS (SELECT 1 FROM runs u WHERE u.tree IS NULL AND u.depth = w.depth)),
root AS (SELECT node AS root FROM top WHERE total = 1)
SELECT doc_id, leaf, roots.node AS subroot, root, sha256(proof) AS proof_sha256, done.node AS folded_root, done.node = root AS verified, (length(proof) // 64)::BIGINT AS n_siblings
FROM r JOIN roots USING (tree) JOIN done ON own = r.tree AND leaf_pos = r.pos, root""",
}
