"""The subpackage's registered queries: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.llm import ball_kmeans, bpe, html_text, latent_decontamination, line_dedup, order_minhash, periodic_runs, quality_rules, simhash, substring_index, subword_classifier, suffix_merge, tool_calls

from satchel.llm.store import small_batches

RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tool calls: each user turn t is a call ``call_<t>`` of the tool ``reply``, which names the call of
    turn t - 2 if there is one, and the assistant's turn t + 1 is its result."""
    turns = _table(spark, sf_dir, "conversations")
    name = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    arguments = F.to_json(F.struct("text", F.when(F.col("turn") > 1, F.concat(F.lit("$"), name(F.col("turn") - 2))).alias("after"), "turn"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("reply").alias("name"), arguments.alias("arguments"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame([("reply", "text", "string", True), ("reply", "turn", "integer", True), ("reply", "after", "string", False)], "name string, field string, type string, required boolean")
    return tool_calls.link(calls, results, schemas).select("conv_id", "call_id", "turn", "depth", "n_results", "valid", "json")


def op3_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, every item against every document."""
    return latent_decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and robust outlier verdict of every document."""
    found = quality_rules.rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op5_subword_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return subword_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "quality", 0.3)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes of every document."""
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_suffix_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes, removed bytes and spans, and digest of the kept bytes of every document, over windows of 400 bytes."""
    return suffix_merge.remove_repeats(_table(spark, sf_dir, "documents"), window=400)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of three-word shingles and the component over links of three bits or fewer, of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3, width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, removed lines and digest of the kept lines of every document."""
    return line_dedup.digests(_table(spark, sf_dir, "documents"))


def op10_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, removed words and digest of the kept words of every document, over windows of 20 words."""
    return substring_index.remove_repeats(_table(spark, sf_dir, "documents"), window=20, batches=3)


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text, and their likeness."""
    return order_minhash.edited_likeness(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, every tenth made periodic, and digests of the runs and of the words that stay."""
    found = periodic_runs.collapse(periodic_runs.with_planted_runs(_table(spark, sf_dir, "documents")))
    return found.drop("runs", "kept")


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of the embeddings after three rounds."""
    order = F.sha2(F.concat(F.lit("1:"), F.col("key").cast("string")), 256)
    return ball_kmeans.clusters(_table(spark, sf_dir, "embeddings"), k=16, rounds=3, order=order)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_html_text": op1_html_text, "op2_tool_calls": op2_tool_calls, "op3_latent_decontamination": op3_latent_decontamination, "op4_quality_rules": op4_quality_rules, "op5_subword_classifier": op5_subword_classifier, "op6_bpe": op6_bpe, "op7_suffix_merge": op7_suffix_merge, "op8_simhash": op8_simhash, "op9_line_dedup": op9_line_dedup, "op10_substring_index": op10_substring_index, "op11_order_minhash": op11_order_minhash, "op12_periodic_runs": op12_periodic_runs, "op13_ball_kmeans": op13_ball_kmeans, "pipeline": pipeline}


OP2_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL
), results AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS result, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY ALL
), walk AS (
  SELECT c.conv_id, c.turn, 1::BIGINT AS depth FROM calls c
  WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL
  SELECT c.conv_id, c.turn, w.depth + 1 FROM walk w JOIN calls c ON c.conv_id = w.conv_id AND c.turn = w.turn + 2
)
SELECT conv_id, 'call_' || turn AS call_id, turn, depth, coalesce(n, 0)::BIGINT AS n_results, text IS NOT NULL AS valid,
  '{"arguments":{' || CASE WHEN turn > 1 THEN '"after":"$call_' || (turn - 2) || '",' ELSE '' END
  || CASE WHEN text IS NOT NULL THEN '"text":' || to_json(text)::VARCHAR || ',' ELSE '' END || '"turn":' || turn || '}'
  || ',"depth":' || depth || ',"id":"call_' || turn || '","name":"reply"'
  || CASE WHEN result IS NOT NULL THEN ',"result":' || to_json(result)::VARCHAR ELSE '' END
  || ',"valid":' || (text IS NOT NULL) || '}' AS json
FROM calls JOIN walk USING (conv_id, turn) LEFT JOIN results USING (conv_id, turn)
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP9_SQL = rf"""
WITH lines AS (
  SELECT doc_id, i, l, regexp_extract_all(l, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS l FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))
), sets AS (
  SELECT doc_id, i, list_distinct([array_to_string(w[k:k + 4], ' ') FOR k IN range(1, greatest(len(w) - 3, 2))]) AS s FROM lines WHERE len(w) >= 1
), tokens AS (SELECT doc_id, i, len(s) AS n, unnest(s) AS t FROM sets),
frequent AS (SELECT t, count(*) AS df FROM tokens GROUP BY t),
ranked AS (SELECT doc_id, i, n, t, row_number() OVER (PARTITION BY doc_id, i ORDER BY df, t) AS p FROM tokens JOIN frequent USING (t)),
prefixes AS (SELECT * FROM ranked WHERE p <= n - ceil(0.8 * n) + 1),
pairs AS (
  SELECT DISTINCT a.doc_id, a.i, b.doc_id AS d, b.i AS j FROM prefixes a JOIN prefixes b ON a.t = b.t
  WHERE (b.doc_id, b.i) < (a.doc_id, a.i) AND b.n >= 0.8 * a.n - 1e-9 AND a.n >= 0.8 * b.n - 1e-9
), gone AS (
  SELECT DISTINCT p.doc_id, p.i FROM pairs p JOIN sets a ON a.doc_id = p.doc_id AND a.i = p.i JOIN sets b ON b.doc_id = p.d AND b.i = p.j
  WHERE len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9
)
SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, sha256(coalesce(string_agg(l.l, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
"""

OP10_SQL = rf"""
WITH words AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, k, sha256(array_to_string(w[k:k + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS k FROM words WHERE len(w) >= 20)
), again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS r FROM windows) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, k + o AS i FROM again, range(0, 20) AS t(o)),
each AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS x FROM words),
kept AS (SELECT e.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY e.i) AS t FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i WHERE g.i IS NULL GROUP BY e.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""


def _op13_sql(k: int = 16, rounds: int = 3) -> str:
    steps = [f"""
kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < {k}
)"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS (
  SELECT r, min({{'d': list_sum(list_transform(list_zip(kept.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'c': c{i}.c}}) AS m FROM kept CROSS JOIN c{i} GROUP BY r
)""")
        if i < rounds:
            steps.append(f"""
s{i} AS (
  SELECT c, list(f ORDER BY i) AS v FROM (
    SELECT c, i, floor(sum(x) / count(*))::BIGINT AS f FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i} JOIN kept USING (r)) GROUP BY c, i
  ) GROUP BY c
), c{i + 1} AS (SELECT c, coalesce(s{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN s{i} USING (c))""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, sum(m.d) OVER (PARTITION BY m.c)::BIGINT AS cluster_inertia, sum(m.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} ON c{rounds}.c = m.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_calls": OP2_SQL, "op9_line_dedup": OP9_SQL, "op10_substring_index": OP10_SQL, "op13_ball_kmeans": _op13_sql()}
