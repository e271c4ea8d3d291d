"""Queries of the operators in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, fertility, langid, packing, pii, quality, repair, simhash, substrings, toxicity, urls, variants


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.report(read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(read(spark, sf_dir, "pages"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(read(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(read(spark, sf_dir, "conversations"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(read(spark, sf_dir, "conversations"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.report(read(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_fertility": op3_fertility,
    "op4_packing": op4_packing,
    "op5_decontamination": op5_decontamination,
    "op6_urls": op6_urls,
    "op7_substrings": op7_substrings,
    "op8_langid": op8_langid,
    "op9_simhash": op9_simhash,
    "op10_chat": op10_chat,
    "op11_repair": op11_repair,
    "op12_variants": op12_variants,
    "op13_quality": op13_quality,
}

#: A list of 256 numbers, and the unsigned crc32 of a list of bytes with it.
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END))"
_CRC = "xor(4294967295, list_reduce([4294967295] || {bytes}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _edit(x: str, cost: str, name: str) -> str:
    """A cost of six digits and an audit, after one more edit."""
    return f"(lpad(CAST(CAST(left({x}, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({x}, 7) || '{name}')"


def _row_edits(kept: dict[str, str], chosen: list[str]) -> str:
    """The least of keeping (initial: state before) and of giving a role."""
    edits = [f"CASE WHEN code <> 'x' AND initial = '{i}' THEN {_edit(g, 'late', 'K')} END" for i, states in kept.items() for g in states.split()]
    return ", ".join([*edits, *(f"CASE WHEN code <> 'x' THEN {_edit(g, '2 + late', 'R')} END" for g in chosen)])

ORACLE_SQL: dict[str, str] = {
    "op10_chat": r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), k AS (
  SELECT *, len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}|[^ \t\n\r\f\x0b\p{L}\p{M}\p{N}]')) + 4 AS tok,
    length(regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g')) + 17 AS size
  FROM t
), p AS (
  SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(tok) OVER (PARTITION BY conv_id) AS total
  FROM k
), y AS (
  SELECT conv_id, min(start) AS sys_start, arg_min(tok, start) AS sys_tok, arg_min(size, start) AS sys_size FROM p WHERE role = 'system' GROUP BY 1
), r AS (
  SELECT p.*, sys_start, sys_size, greatest((768 - coalesce(sys_tok, 0)) // 2, 128) AS room FROM p LEFT JOIN y USING (conv_id)
), s AS (
  SELECT *, max(start + tok) OVER (PARTITION BY conv_id, start // room, tok > room) AS stop, min(start) OVER (PARTITION BY conv_id, start // room, tok > room) AS begin FROM r
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + coalesce(sum(size) FILTER (start >= stop - 256 AND role <> 'system' AND stop < total), 0) + 3 * count(DISTINCT begin) + coalesce(any_value(sys_size) * count(DISTINCT begin) FILTER (begin > sys_start), 0) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""",
    "op11_repair": rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT {_CRC_TABLE} AS t
), ruled AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC.format(bytes="list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 20 AS rule
  FROM conversations, crc
), d AS (
  SELECT conv_id, turn, CASE rule WHEN 4 THEN 'user' ELSE role END AS role,
    CASE rule WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE rule WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM ruled)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d
), f AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '-' END AS fault,
    left(role, 1) AS initial
  FROM o
), r AS MATERIALIZED (
  SELECT *, CASE WHEN fault IN ('b', 'd') THEN 'x' ELSE '' END AS code, CASE fault WHEN 't' THEN 1 ELSE 0 END AS late,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd, i > 1 AS later
  FROM f
), steps(conv_id, i, b0, b1, b2, b3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '000000', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR) FROM r WHERE i = 1
  UNION ALL
  SELECT conv_id, i, {_edit("g0", "3", "D")}, least({_edit("g1", "3", "D")}, {_row_edits({"s": "g0"}, [])}),
    least({_edit("g2", "3", "D")}, {_row_edits({"u": "g0 g1 g3"}, ["g0", "g1", "g3"])}), least({_edit("g3", "3", "D")}, {_row_edits({"a": "g2"}, ["g2"])})
  FROM (
    SELECT r.conv_id, r.i, code, late, initial, b0 AS g0, b1 AS g1, least(b2, {_edit("b0", "2", "I")}, {_edit("b1", "2", "I")}, {_edit("b3", "2", "I")}) AS g2, least(b3, {_edit("b2", "2", "I")}) AS g3
    FROM steps JOIN r ON r.conv_id IS NOT DISTINCT FROM steps.conv_id AND r.i = steps.i + 1
  )
), ends AS (
  SELECT conv_id, arg_max(least(b0, {_edit("b1", "4", "II")}, {_edit("b2", "2", "I")}, b3), i) AS best FROM steps GROUP BY conv_id
), audits AS (
  SELECT conv_id, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM ends
), edits AS (
  SELECT conv_id, k, substr(audit, k, 1) AS edit, k - length(replace(left(audit, k), 'I', '')) AS inserted
  FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS k FROM audits)
), kept AS (
  SELECT e.conv_id, k, edit, role, text, row_number() OVER (PARTITION BY e.conv_id ORDER BY k) AS m
  FROM edits e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = k - inserted AND edit <> 'I' WHERE edit <> 'D'
), roles AS (
  SELECT *, bool_or(m = 1 AND edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS has_system FROM kept
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (m - has_system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY m) AS lines
  FROM roles GROUP BY conv_id
), stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (odd) AS illegal
  FROM r GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op12_variants": rf"""
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT {_CRC_TABLE} AS t
), runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents
), counted AS (
  SELECT id, w, count(*) AS n FROM runs GROUP BY 1, 2
), prefixes AS (
  SELECT id, {_CRC.format(bytes="list_transform(string_split(id || ':', ''), lambda x: CAST(ascii(x) AS BIGINT))")} AS start FROM (SELECT DISTINCT id FROM counted), crc
), hashed AS (
  SELECT w, n, xor(4294967295, list_reduce([xor(4294967295, start)] || flatten(list_transform(string_split(w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, unicode(x) - 64] END)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM counted JOIN prefixes USING (id), crc
), v AS MATERIALIZED (
  SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, CAST(sum(n) AS BIGINT) AS n
  FROM hashed GROUP BY 1 HAVING sum(n) >= 3 AND length(word) >= 5
), gone AS MATERIALIZED (
  SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)
), longer AS (
  SELECT DISTINCT gone.word AS long, gone.n AS long_n, v.word AS short, v.n AS short_n FROM gone JOIN v ON gone.rest = v.word
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION ALL SELECT long, short, short_n FROM longer UNION ALL SELECT short, long, long_n FROM longer
), best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
), f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)
), way(word, goal, k) AS (
  SELECT word, form, 1 FROM f WHERE form IS NOT NULL
  UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.goal WHERE f.form IS NOT NULL
)
SELECT word, form, coalesce(r.goal, word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT word, arg_max(goal, k) AS goal FROM way GROUP BY 1) r USING (word)
""",
    "op6_urls": r"""
WITH rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), fits AS (
  SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)
""",
    "op5_decontamination": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, list_aggregate(w[p : p + least(len(w), 10) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS p FROM b WHERE len(w) > 0)
), ks AS (
  SELECT DISTINCT k FROM bw
), dw AS (
  SELECT doc_id, k, p, list_aggregate(w[p : p + k - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS p FROM d, ks WHERE len(w) >= k)
), m AS (
  SELECT doc_id, item_id, p, k FROM dw JOIN bw USING (k, win)
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + k - 1)) AS q FROM m) GROUP BY 1
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(i.names, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
""",
}
