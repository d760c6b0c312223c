"""The pN_ queries of this subpackage and their SQL; each runs over its whole tables with production parameters."""

from __future__ import annotations

from auditloom.llm import function_docs, invalid_files, leaks, mixture, pii, quality, secrets, split
from auditloom.tables import table


def _chunks(spark, d):
    return table(spark, d, "code_chunks")


def _documents(spark, d):
    return table(spark, d, "documents")


def _pii(spark, d):
    return table(spark, d, "audit_logs"), table(spark, d, "tool_requests")


QUERIES = {
    "p1_found": lambda s, d: pii.found(*_pii(s, d)),
    "p1_redacted": lambda s, d: pii.redacted(*_pii(s, d)),
    "p2_found": lambda s, d: invalid_files.invalid_files(_chunks(s, d)),
    "p2_rates": lambda s, d: invalid_files.invalid_rates(_chunks(s, d)),
    "p5_found": lambda s, d: function_docs.documented_valid(_chunks(s, d)),
    "p7_found": lambda s, d: secrets.secret_lines(_chunks(s, d)),
    "p7_redacted": lambda s, d: secrets.redact(_chunks(s, d)),
    "p8_found": lambda s, d: leaks.leaked(_documents(s, d), table(s, d, "eval_items")),
    "p8_report": lambda s, d: leaks.leak_report(_documents(s, d), table(s, d, "eval_items")),
    "p10_found": lambda s, d: quality.text_kinds(_documents(s, d)),
    "p10_stats": lambda s, d: quality.statistics(_documents(s, d)),
    "p4_found": lambda s, d: split.oversized(_chunks(s, d), table(s, d, "split_limits")),
    "p4_pieces": lambda s, d: split.pieces(_chunks(s, d), table(s, d, "split_limits")),
    "p9_mix": lambda s, d: mixture.mixed(_documents(s, d), table(s, d, "mix_targets")),
    "p9_shares": lambda s, d: mixture.shares(_documents(s, d), table(s, d, "mix_targets")),
    "p5_pairs": lambda s, d: function_docs.function_pairs(_chunks(s, d)),
}

_WORDS = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[\x{AD}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

ORACLES: dict[str, str] = {
    "p4_found": "SELECT DISTINCT chunk_id FROM code_chunks JOIN split_limits USING (chunk_type) WHERE length(content) > max_chars",
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM d, unnest(range(1, len(w) - 10)) AS t(k)),
ig AS (SELECT item_id, array_to_string(w[k:k+11], ' ') AS g FROM i, unnest(range(1, len(w) - 10)) AS t(k))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p10_stats": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') AS l FROM t)
SELECT doc_id, len(w)::BIGINT AS n_words,
  round(coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 0), 6) AS mean_word_length,
  round(coalesce(length(regexp_replace(t, '[\\p{{L}}\\p{{N}}\\s]+', '', 'g'))::DOUBLE / nullif(length(t), 0), 0), 6) AS symbol_ratio,
  round(coalesce(len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;][)"'']*\\s*$')))::DOUBLE / nullif(len(l), 0), 0), 6) AS stopped_lines,
  round(coalesce(len(list_filter(w, lambda x: list_contains([{', '.join(repr(c) for c in sorted(quality.COMMON))}], x)))::DOUBLE / nullif(len(w), 0), 0), 6) AS common_words
FROM p""",
}
