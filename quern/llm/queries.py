"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import documents
from quern.llm.bpe import encode_decode
from quern.llm.exact_dedup import exact_dedup
from quern.llm.fingerprints import fingerprint_documents
from quern.llm.language_id import language_id
from quern.llm.license_scan import scan_documents
from quern.llm.line_dedup import line_dedup
from quern.llm.packing import best_fit
from quern.llm.simhash_dedup import simhash_components
from quern.llm.suffix_dedup import remove_repeats
from quern.llm.tool_calls import chat_lines

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_lines(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP1_SQL = """WITH RECURSIVE tagged AS (
  SELECT *, to_json(text)::VARCHAR AS quoted, conv_id + turn AS k,
         CASE role WHEN 'user' THEN conv_id || '-' || turn || '-reply' WHEN 'assistant' THEN conv_id || '-' || (turn - 1) || '-reply' END AS call_id
  FROM conversations),
calls AS (
  SELECT conv_id, turn, t.tool, t.pos, conv_id || '-' || turn || '-' || t.tool AS id,
         CASE t.tool WHEN 'reply' THEN '{' || CASE WHEN k % 7 = 3 THEN '"draft":true,' ELSE '' END || '"prompt":' || quoted || ',"turn":' || turn || '}'
                     WHEN 'count' THEN '{' || CASE WHEN k % 5 <> 0 THEN '"chars":' || length(text) || ',' ELSE '' END || '"text":' || quoted || '}'
                     ELSE '{"text":' || quoted || '}' END AS arguments,
         text IS NOT NULL AND CASE t.tool WHEN 'reply' THEN k % 7 <> 3 WHEN 'count' THEN k % 5 <> 0 ELSE true END AS valid
  FROM tagged, (VALUES ('reply', 0), ('count', 1), ('split', 2)) AS t(tool, pos) WHERE role = 'user'),
edges AS (
  SELECT conv_id, turn, 'reply' AS child, 'count' AS parent FROM tagged WHERE role = 'user' UNION ALL
  SELECT conv_id, turn, 'count', 'split' FROM tagged WHERE role = 'user' UNION ALL
  SELECT conv_id, turn, 'count', 'reply' FROM tagged WHERE role = 'user' AND k % 11 = 4),
walk AS (
  SELECT conv_id, turn, 'split' AS tool, 0 AS depth FROM tagged WHERE role = 'user' UNION
  SELECT w.conv_id, w.turn, e.child, w.depth + 1 FROM walk w JOIN edges e ON w.conv_id = e.conv_id AND w.turn = e.turn AND w.tool = e.parent WHERE w.depth < 6),
levels AS (SELECT conv_id, turn, tool, CASE WHEN max(depth) < 3 THEN max(depth) END AS level FROM walk GROUP BY ALL),
made AS (
  SELECT c.conv_id, c.turn, bool_and(valid) AS valid, CASE WHEN count(level) = 3 THEN max(level) END AS level,
         '[' || string_agg('{"arguments":' || arguments || ',"id":"' || id || '","name":"' || c.tool || '"}', ',' ORDER BY level NULLS LAST, pos) || ']' AS list
  FROM calls c JOIN levels l ON c.conv_id = l.conv_id AND c.turn = l.turn AND c.tool = l.tool GROUP BY ALL),
asked AS (SELECT DISTINCT call_id FROM tagged WHERE role = 'user'),
answered AS (SELECT call_id, min(turn) AS turn FROM tagged WHERE role = 'assistant' GROUP BY call_id),
met AS (
  SELECT t.*, CASE role WHEN 'user' THEN r.call_id IS NOT NULL
                        WHEN 'assistant' THEN a.call_id IS NOT NULL AND t.turn = r.turn ELSE false END AS linked,
         CASE WHEN role = 'user' THEN t.turn > 0 AND b.call_id IS NULL END AS unmet
  FROM tagged t LEFT JOIN asked a ON t.call_id = a.call_id LEFT JOIN answered r ON t.call_id = r.call_id
       LEFT JOIN asked b ON b.call_id = t.conv_id || '-' || (t.turn - 2) || '-reply')
SELECT m.conv_id, m.turn, role, call_id, linked, valid, unmet, level,
       '{' || CASE WHEN role = 'user' THEN '"calls":' || list || ',' ELSE '' END
           || '"content":' || quoted || CASE WHEN role = 'assistant' AND linked THEN ',"result_of":"' || call_id || '"' ELSE '' END
           || ',"role":"' || role || '","turn":' || m.turn || '}' AS line
FROM met m LEFT JOIN made d ON m.conv_id = d.conv_id AND m.turn = d.turn AND m.role = 'user'"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir))


OP8_SQL = r"""WITH cut AS (
  SELECT doc_id, coalesce(source, '') AS site, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, site, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM cut),
spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM lines WHERE NOT regexp_full_match(line, '[ \t\n\x0B\f\r]*')
  GROUP BY line HAVING count(DISTINCT site) >= 10),
judged AS (
  SELECT doc_id, pos, l.line, s.line IS NOT NULL AND (doc_id, pos) <> s.first AS gone FROM lines l LEFT JOIN spread s ON l.line = s.line),
joined AS (
  SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM judged GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, length(kept) AS kept_chars, sha256(kept) AS kept_sha256 FROM joined"""

OP9_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


def queries() -> dict[str, Query]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_license_scan": op2_license_scan,
        "op3_fingerprints": op3_fingerprints,
        "op4_bpe": op4_bpe,
        "op5_suffix_array_dedup": op5_suffix_array_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_simhash_near_dedup": op7_simhash_near_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": OP1_SQL, "op8_line_dedup": OP8_SQL, "op9_exact_dedup": OP9_SQL}
