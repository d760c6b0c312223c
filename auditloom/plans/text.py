"""Queries on sanitising and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import sanitize as S
from auditloom.operators import retrieval as R
from auditloom.operators import scoring as P
from auditloom.operators import validation as V
from auditloom.plans.audit import CALLS, c
from auditloom.session import written
from auditloom.tables import table

EVERY = 50  # searches take the rows whose id is divisible by this as queries


def docs(s, d):
    return table(s, d, "documents").select("doc_id", "text", "title", "repo")


def chunks(s, d):
    return table(s, d, "code_chunks")


def index(s, d):
    return R.postings(docs(s, d), "doc_id", "text")


def questions(s, d):
    return docs(s, d).where(F.col("doc_id") % EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


def bm25_hits(s, d, k):
    """Over blocks of documents that are written once and read by each block of queries."""
    return P.bm25_blocks(written(P.packed_documents(docs(s, d), "doc_id", "text"), "documents"), questions(s, d), "doc_id", k)


def vectors(s, d):
    return table(s, d, "embeddings")


def vector_hits(s, d, k, metric="ip"):
    v = vectors(s, d)
    return R.vector_topk(v, v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding"), k, metric)


def cache_match(hits, least=0.3):
    """The best hit of each query but itself, from its two best; an exact copy with a smaller id ranks before the query."""
    best = hits.where("query_id <> vec_id").groupBy("query_id").agg(F.min_by(F.struct("vec_id", "score"), "rank").alias("h"))
    return best.where(F.col("h.score") >= least).select("query_id", "h.vec_id", F.round("h.score", 4).alias("score"))


def _hybrid(s, d):
    return R.fuse(bm25_hits(s, d, 50), vector_hits(s, d, 50).withColumnRenamed("vec_id", "doc_id"), 10)


def _outputs(s, d):
    return table(s, d, "audit_logs").select("id", F.col("tool_output_sanitized").alias("text"))


def _inputs(s, d):
    return table(s, d, "audit_logs").select("id", F.col("tool_input").alias("text"))


def _manifest(s, d):
    """Change of every file between its first and its last indexing: md5 of the rows by time."""
    rows = chunks(s, d).where("indexed_at IS NOT NULL").select("repo", "file_path", "start_line", "end_line", F.md5("content").alias("md5"), "indexed_at")
    g = rows.groupBy("repo", "file_path", "start_line", "end_line").agg(F.min_by("md5", F.struct("indexed_at", "md5")).alias("first"), F.max_by("md5", F.struct("indexed_at", "md5")).alias("last"), F.count(F.lit(1)).alias("n"))
    return g.where("n > 1").groupBy("repo").agg(F.count_if(F.col("first") == F.col("last")).alias("unchanged"), F.count_if(F.col("first") != F.col("last")).alias("changed"))


def _enriched(s, d):
    return bm25_hits(s, d, 5).join(docs(s, d), "doc_id").select("query_id", "rank", "doc_id", "repo", "title")


# Line beginnings that define or import in Python sources.
DEFINITIONS = {"functions": r"^\s*(?:async\s+)?def\s+\w+", "classes": r"^\s*class\s+\w+", "imports": r"^\s*(?:import|from)\s+[\w.]+"}


def _definition_counts(s, d):
    lines = chunks(s, d).where("lower(file_path) LIKE '%.py'").select("repo", F.split("content", "\n", -1).alias("l"))

    def matching(pattern):
        return F.size(F.filter("l", lambda x: F.rlike(x, F.lit(pattern))))

    return lines.groupBy("repo").agg(*[F.sum(matching(p)).alias(k) for k, p in DEFINITIONS.items()])


def _record(s, d):
    """The audit record as it is stored: sanitised and cut input, hash of the raw output."""
    t = table(s, d, "audit_logs")
    return t.select("id", S.truncated(S.applied(F.col("tool_input")), 100).alias("input"), F.sha2("tool_output_sanitized", 256).alias("output_hash"), S.hash_value(F.col("ip_address")).alias("ip"))


QUERIES = {
    "detect_rules": lambda s, d: chunks(s, d).select("chunk_id", S.detected(F.col("content")).alias("rules")),
    "detect_rules_output": lambda s, d: _outputs(s, d).select("id", S.detected(F.col("text")).alias("rules")),
    "scan_counts": lambda s, d: chunks(s, d).select("chunk_id", *[S.match_count(F.col("content"), r.pattern).cast("bigint").alias(r.name) for r in S.RULES]),
    "scan_secrets": lambda s, d: chunks(s, d).select("chunk_id", *[S.match_count(F.col("content"), r.pattern).cast("bigint").alias(r.name) for r in S.SCANNER]),
    "has_secrets": lambda s, d: chunks(s, d).select("chunk_id", S.has_secrets(F.col("content")).alias("has_secrets")),
    "scan_spans": lambda s, d: chunks(s, d).select("chunk_id", F.explode(S.spans(F.col("content"))).alias("x")).select("chunk_id", "x.rule", "x.start", "x.match"),
    "invalid_calls": lambda s, d: V.invalid(c(s, d), "id", V.CALL_CHECKS),
    "invalid_chunks": lambda s, d: V.invalid(chunks(s, d), "chunk_id", V.CHUNK_CHECKS),
    "redact_rules": lambda s, d: chunks(s, d).select("chunk_id", S.applied(F.col("content"), [r for r in S.RULES if r.action == "redact"]).alias("content")),
    "hash_matches": lambda s, d: _outputs(s, d).select("id", S.hashed(F.col("text"), S.RULES[6].pattern).alias("text")),
    "mask_cards": lambda s, d: _outputs(s, d).select("id", S.masked(F.col("text"), S.RULES[8].pattern).alias("text")),
    "remove_rule": lambda s, d: _inputs(s, d).select("id", S.applied(F.col("text"), [S.Rule("ssn", S.RULES[7].pattern, "remove")]).alias("text")),
    "sanitize_all": lambda s, d: _inputs(s, d).select("id", S.applied(F.col("text")).alias("text")),
    "hash_pii": lambda s, d: table(s, d, "audit_logs").select("id", S.hash_value(F.col("user_id")).alias("user_hash")),
    "truncate_text": lambda s, d: docs(s, d).select("doc_id", S.truncated(F.col("text"), 200).alias("text")),
    "audit_record": _record,
    "tokenize": lambda s, d: chunks(s, d).select("chunk_id", F.array_join(R.code_tokens(F.col("content")), " ").alias("tokens")),
    "searchable_text": lambda s, d: chunks(s, d).select("chunk_id", F.md5(R.searchable(F.col("chunk_type"), F.col("name"), F.col("docstring"), F.col("content"))).alias("md5")),
    "chunk_lines": lambda s, d: R.line_chunks(chunks(s, d), "chunk_id", "content"),
    "chunk_split": lambda s, d: R.split_large(chunks(s, d), "chunk_id", "content", "start_line", "name"),
    "definition_counts": _definition_counts,
    "expand_query": lambda s, d: table(s, d, "tool_requests").where("user_stated_intent IS NOT NULL").select("req_id", R.expanded(F.col("user_stated_intent")).alias("query")),
    "fenced_json": lambda s, d: docs(s, d).select("doc_id", R.fenced(F.col("text")).alias("body")),
    "chunk_tokens": lambda s, d: R.token_chunks(docs(s, d), "doc_id", "text", 100),
    "read_head_lines": lambda s, d: chunks(s, d).select("chunk_id", F.size(F.split("content", "\n", -1)).alias("n_lines"), F.array_join(F.slice(F.split("content", "\n", -1), 1, 10), "\n").alias("head")),
    "grep_lines": lambda s, d: chunks(s, d).select("chunk_id", F.posexplode(F.split("content", "\n", -1)).alias("k", "line")).where(F.rlike("line", F.lit("(?i)\\bpassword\\b"))).select("chunk_id", (F.col("k") + 1).alias("line_no"), F.substring(F.trim("line"), 1, 200).alias("line")),
    "diff_stats": lambda s, d: chunks(s, d).select("repo", F.size(F.filter(F.split("content", "\n", -1), lambda x: F.rlike(x, F.lit("^(?:<<<<<<<|=======|>>>>>>>)")))).alias("m")).groupBy("repo").agg(F.count_if(F.col("m") > 0).alias("rows_with_markers"), F.sum("m").alias("markers")),
    "token_df": lambda s, d: R.document_frequency(index(s, d)),
    "token_idf": lambda s, d: R.document_frequency(index(s, d)).crossJoin(F.broadcast(R.corpus(docs(s, d), "text"))).select("token", F.round(R.idf(F.col("n_docs"), F.col("df")), 6).alias("idf")),
    "corpus_stats": lambda s, d: R.corpus(docs(s, d), "text").select("n_docs", F.round("avg_dl", 6).alias("avg_dl")),
    "bm25_topk": lambda s, d: bm25_hits(s, d, 10).select("query_id", "doc_id", "rank"),
    "search_enrich": _enriched,
    "vector_topk_ip": lambda s, d: vector_hits(s, d, 10).select("query_id", "vec_id", "rank"),
    "vector_topk_l2": lambda s, d: vector_hits(s, d, 10, "l2").select("query_id", "vec_id", "rank"),
    "hybrid_search": _hybrid,
    "semantic_cache_match": lambda s, d: cache_match(vector_hits(s, d, 2)),
    "centroid_classify": lambda s, d: R.classify(vectors(s, d), R.centroids(vectors(s, d))).select("vec_id", "label"),
    "manifest_diff": _manifest,
}

_TOK = "list_filter(regexp_split_to_array(lower(regexp_replace(replace(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '[^\\p{{L}}\\p{{N}}\\s.]', ' ', 'g')), '\\s+'), lambda t: length(t) > 1)"
_POST = f"""t AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents), post AS (SELECT doc_id, len(t) AS dl, tok AS token, count(*) AS tf FROM t, unnest(t) AS u(tok) GROUP BY ALL),
fig AS (SELECT count(*) AS n_docs, avg(len(coalesce(t, []))) AS avg_dl FROM t), dfs AS (SELECT token, count(*) AS df FROM post GROUP BY 1)"""
_BM = f"""WITH {_POST}, q AS (SELECT doc_id AS query_id, tok AS token, count(*) AS qn FROM t, unnest(t) AS u(tok) WHERE doc_id % 50 = 0 GROUP BY ALL),
s AS (SELECT query_id, post.doc_id, round(sum(qn * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM q JOIN post USING (token) JOIN dfs USING (token), fig GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)"""
_VEC = """v AS (SELECT q.vec_id AS query_id, e.vec_id, {score} AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v)"""
_IP = "round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6)"
_L2 = "-round(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"
_LINES = "string_split({0}, chr(10))"


def _sql_replace(text: str, rules) -> str:
    for r in rules:
        text = f"regexp_replace({text}, '{r.pattern}', '{'' if r.action == 'remove' else r.marker}', 'g')"
    return text


def _sql_each(text: str, pattern: str, change: str) -> str:
    found = f"list_sort(list_transform(list_distinct(regexp_extract_all({text}, '{pattern}')), lambda m: {{'k': -length(m), 'm': m}}))"
    return f"list_reduce(list_transform({found}, lambda m: m.m), lambda t, m: replace(t, m, {change}), {text})"


_HASH = "'[HASH:' || substr(sha256('audit' || m), 1, 12) || ']'"
_MASK = "CASE WHEN length(m) <= 4 THEN repeat('*', length(m)) ELSE m[1] || repeat('*', length(m) - 2) || right(m, 1) END"


def _sql_applied(text: str) -> str:
    for r in S.RULES:
        text = _sql_each(text, r.pattern, _HASH) if r.action == "hash" else _sql_each(text, r.pattern, _MASK) if r.action == "mask" else _sql_replace(text, [r])
    return text


def _sql_steps(column: str, table_name: str, key: str) -> str:
    """All rules as a chain of common table expressions, one per rule."""
    out, last = [f"s0 AS (SELECT {key}, {column} AS t FROM {table_name})"], 0
    for i, r in enumerate(S.RULES, 1):
        e = _sql_each("t", r.pattern, _HASH) if r.action == "hash" else _sql_each("t", r.pattern, _MASK) if r.action == "mask" else _sql_replace("t", [r])
        out.append(f"s{i} AS (SELECT {key}, {e} AS t FROM s{i - 1})")
        last = i
    return ", ".join(out) + f", done AS (SELECT {key}, t FROM s{last})"


_DETECT = "concat_ws(','," + ", ".join(f"CASE WHEN regexp_matches({{0}}, '{r.pattern}') THEN '{r.name}' END" for r in S.RULES).replace("{", "{{").replace("}", "}}").replace("{{0}}", "{0}") + ")"

_SPANS = " UNION ALL ".join(
    f"SELECT chunk_id, '{r.name}' AS rule, coalesce(list_sum(list_transform(b[1:k], lambda x: length(x))), 0)::INT + coalesce(list_sum(list_transform(f[1:k-1], lambda x: length(x))), 0)::INT AS start, f[k] AS match"
    f" FROM (SELECT chunk_id, regexp_extract_all(content, '{r.pattern}') AS f, regexp_split_to_array(content, '{r.pattern}') AS b FROM code_chunks), unnest(range(1, len(f) + 1)) AS t(k)"
    for r in S.SCANNER
)

ORACLES = {
    "has_secrets": "SELECT chunk_id, coalesce(" + " OR ".join(f"regexp_matches(content, '{r.pattern}')" for r in S.SCANNER) + ", false) AS has_secrets FROM code_chunks",
    "scan_spans": _SPANS,
    "invalid_calls": f"WITH {CALLS}, e AS (SELECT id, {V.sql_errors(V.CALL_CHECKS)} AS errors FROM calls) SELECT * FROM e WHERE errors <> ''",
    "invalid_chunks": f"WITH e AS (SELECT chunk_id, {V.sql_errors(V.CHUNK_CHECKS)} AS errors FROM code_chunks) SELECT * FROM e WHERE errors <> ''",
    "chunk_split": f"""WITH l AS (SELECT chunk_id, coalesce(start_line, 1) AS first, name, {_LINES.format('content')} AS l FROM code_chunks WHERE length(content) > 1500)
SELECT chunk_id, s // 27 + 1 AS part, name || '_part' || (s // 27 + 1) AS name, first + s AS start_line, first + least(s + 30, len(l)) - 1 AS end_line, array_to_string(l[s + 1 : s + 30], chr(10)) AS content FROM l, unnest(range(0, len(l), 27)) AS t(s)""",
    "definition_counts": "SELECT repo, " + ", ".join(f"sum(len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '{p}'))))::BIGINT AS {k}" for k, p in DEFINITIONS.items()) + " FROM code_chunks WHERE lower(file_path) LIKE '%.py' GROUP BY 1",
    "expand_query": "SELECT req_id, user_stated_intent || " + " || ".join(f"CASE WHEN contains(lower(user_stated_intent), '{t}') THEN ' {w}' ELSE '' END" for t, w in R.SYNONYMS.items()) + " AS query FROM tool_requests WHERE user_stated_intent IS NOT NULL",
    "fenced_json": "SELECT doc_id, trim(CASE WHEN regexp_matches(text, '" + R.FENCED + "') THEN regexp_extract(text, '" + R.FENCED + "', 1) ELSE text END, ' ') AS body FROM documents",
    "detect_rules": f"SELECT chunk_id, {_DETECT.format('content')} AS rules FROM code_chunks",
    "detect_rules_output": f"SELECT id, {_DETECT.format('tool_output_sanitized')} AS rules FROM audit_logs",
    "scan_counts": "SELECT chunk_id, " + ", ".join(f"coalesce(len(regexp_extract_all(content, '{r.pattern}')), 0) AS {r.name}" for r in S.RULES) + " FROM code_chunks",
    "scan_secrets": "SELECT chunk_id, " + ", ".join(f"coalesce(len(regexp_extract_all(content, '{r.pattern}')), 0) AS {r.name}" for r in S.SCANNER) + " FROM code_chunks",
    "redact_rules": f"SELECT chunk_id, {_sql_replace('content', [r for r in S.RULES if r.action == 'redact'])} AS content FROM code_chunks",
    "hash_matches": f"SELECT id, {_sql_each('tool_output_sanitized', S.RULES[6].pattern, _HASH)} AS text FROM audit_logs",
    "mask_cards": f"SELECT id, {_sql_each('tool_output_sanitized', S.RULES[8].pattern, _MASK)} AS text FROM audit_logs",
    "remove_rule": f"SELECT id, regexp_replace(tool_input, '{S.RULES[7].pattern}', '', 'g') AS text FROM audit_logs",
    "sanitize_all": f"WITH {_sql_steps('tool_input', 'audit_logs', 'id')} SELECT id, t AS text FROM done",
    "hash_pii": "SELECT id, CASE WHEN user_id = '' THEN user_id ELSE substr(sha256('audit' || user_id), 1, 16) END AS user_hash FROM audit_logs",
    "truncate_text": "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '... [truncated]' ELSE text END AS text FROM documents",
    "audit_record": f"WITH {_sql_steps('tool_input', 'audit_logs', 'id')} SELECT id, CASE WHEN length(t) > 100 THEN substr(t, 1, 100) || '... [truncated]' ELSE t END AS input, sha256(tool_output_sanitized) AS output_hash, CASE WHEN ip_address = '' THEN ip_address ELSE substr(sha256('audit' || ip_address), 1, 16) END AS ip FROM done JOIN audit_logs USING (id)",
    "tokenize": f"SELECT chunk_id, array_to_string({_TOK.format('content')}, ' ') AS tokens FROM code_chunks",
    "searchable_text": "SELECT chunk_id, md5(concat_ws(chr(10), '# ' || chunk_type || ': ' || coalesce(name, ''), docstring, content)) AS md5 FROM code_chunks",
    "chunk_lines": f"WITH l AS (SELECT chunk_id, {_LINES.format('content')} AS l FROM code_chunks) SELECT chunk_id, s + 1 AS start_line, least(s + 30, len(l)) AS end_line, array_to_string(l[s + 1 : s + 30], chr(10)) AS content FROM l, unnest(range(0, len(l), 27)) AS t(s)",
    "chunk_tokens": "WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents) SELECT doc_id, s // 100 AS chunk, array_to_string(t[s + 1 : s + 100], ' ') AS content FROM t, unnest(range(0, len(t), 100)) AS u(s)",
    "read_head_lines": f"SELECT chunk_id, len({_LINES.format('content')}) AS n_lines, array_to_string(({_LINES.format('content')})[1:10], chr(10)) AS head FROM code_chunks",
    "grep_lines": "SELECT chunk_id, k AS line_no, substr(trim(l[k]), 1, 200) AS line FROM (SELECT chunk_id, string_split(content, chr(10)) AS l FROM code_chunks), unnest(range(1, len(l) + 1)) AS t(k) WHERE regexp_matches(l[k], '(?i)\\bpassword\\b')",
    "diff_stats": "SELECT repo, count(*) FILTER (m > 0) AS rows_with_markers, sum(m)::BIGINT AS markers FROM (SELECT repo, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^(?:<<<<<<<|=======|>>>>>>>)'))) AS m FROM code_chunks) GROUP BY 1",
    "token_df": f"WITH {_POST} SELECT * FROM dfs",
    "token_idf": f"WITH {_POST} SELECT token, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM dfs, fig",
    "corpus_stats": f"WITH {_POST} SELECT n_docs, round(avg_dl, 6) AS avg_dl FROM fig",
    "bm25_topk": _BM + " SELECT query_id, doc_id, rank FROM bm WHERE rank <= 10",
    "search_enrich": _BM + " SELECT query_id, rank, doc_id, repo, title FROM bm JOIN documents USING (doc_id) WHERE rank <= 5",
    "vector_topk_ip": "WITH " + _VEC.format(score=_IP) + " SELECT query_id, vec_id, rank FROM vr WHERE rank <= 10",
    "vector_topk_l2": "WITH " + _VEC.format(score=_L2) + " SELECT query_id, vec_id, rank FROM vr WHERE rank <= 10",
    "hybrid_search": _BM + ", " + _VEC.format(score=_IP) + """, f AS (SELECT query_id, doc_id, round(coalesce(0.4::DOUBLE / (60 + a.rank), 0) + coalesce(0.6::DOUBLE / (60 + b.rank), 0), 8) AS score
  FROM (SELECT * FROM bm WHERE rank <= 50) a FULL JOIN (SELECT query_id, vec_id AS doc_id, rank FROM vr WHERE rank <= 50) b USING (query_id, doc_id))
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
    "semantic_cache_match": "WITH " + _VEC.format(score=_IP) + " SELECT query_id, vec_id, round(score, 4) AS score FROM vr WHERE rank = 2 AND score >= 0.3",
    "centroid_classify": """WITH m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) WHERE label IS NOT NULL GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT vec_id, c.label, round(list_inner_product(embedding::DOUBLE[], c) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_inner_product(c, c)), 6) AS cos FROM embeddings, c)
SELECT vec_id, label FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) AS r FROM s) WHERE r = 1""",
    "manifest_diff": """WITH g AS (SELECT repo, file_path, start_line, end_line, min_by(md5(content), {'a': indexed_at, 'b': md5(content)}) AS first, max_by(md5(content), {'a': indexed_at, 'b': md5(content)}) AS last
  FROM code_chunks WHERE indexed_at IS NOT NULL GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT repo, count(*) FILTER (first = last) AS unchanged, count(*) FILTER (first <> last) AS changed FROM g GROUP BY 1""",
}
