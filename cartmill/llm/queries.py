"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartmill.llm import decontam, idstore, langid, mixing, ngram_join, ngram_lm, pii, rule_ledger, rulefit, sharding
from cartmill.llm.text import table


def _docs(report: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": _docs(langid.language_report),
        "op2_pii_votes": _docs(pii.pii_report),
        "op3_rule_ensemble": lambda spark, sf_dir: rulefit.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_kneser_ney": _docs(ngram_lm.score_report),
        "op5_curriculum_mix": _docs(mixing.mix_report),
        "op6_simhash_decontam": lambda spark, sf_dir: decontam.match_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op7_jump_shards": _docs(sharding.shard_report),
        "op8_id_store": _docs(idstore.store_report),
        "op9_ngram_join": _docs(ngram_join.join_report),
        "op10_rule_ledger": _docs(rule_ledger.rules_report),
        "ledger_ablations": _docs(rule_ledger.ablation_report),
    }


LEDGER = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM d),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(5)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END + CASE WHEN n_words = 0 THEN 64 ELSE 0 END + CASE WHEN n_dup_lines > 0 THEN 128 ELSE 0 END AS BIGINT) AS failed_bits FROM m)"""
OP10 = f"{LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_bits & 127 = 0 AS kept, failed_bits, 'v1' AS policy FROM b"
_BITS = {"too_short": 1, "repeated_windows": 2, "symbols_over_words": 4, "duplicate_lines": 8, "short_words": 16, "long_words": 32, "no_words": 64}
_CASES = [("base", "NULL", 3), ("base", "'too_short'", 2), ("base", "'repeated_windows'", 1), ("v1", "NULL", 127), *(("v1", f"'{name}'", 127 - bit) for name, bit in _BITS.items())]
ABLATIONS = f"""{LEDGER}, cases AS (SELECT * FROM (VALUES {", ".join(f"('{v}', {out}, CAST({mask} AS BIGINT))" for v, out, mask in _CASES)}) AS c(version, left_out, mask))
SELECT version, left_out, count(*) AS n_docs, count(*) FILTER (failed_bits & mask = 0) AS n_kept, bit_or(failed_bits & mask) AS failed_or, bit_and(failed_bits & mask) AS failed_and FROM b, cases GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    """The other operators' results rest on hashes, models or codes that SQL lacks; tests/llm hold them against brute force."""
    return {"op10_rule_ledger": OP10, "ledger_ablations": ABLATIONS}
