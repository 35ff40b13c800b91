"""Queries over sources and text functions, with their SQL for DuckDB.

The tables hold no repositories, so paths, addresses and records are made from their rows: the SQL then predicts results
from the columns and not by the same functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import text as T
from siltstone.functions.lineage import dealt
from siltstone.functions.vectors import norm
from siltstone.operators import retrieval
from siltstone.sources import files, history, knowledge

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan's rows, dealt to all cores: what is made of each row is long."""
    return dealt(rows)


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE source END AS owner, CASE WHEN doc_id % 5 = 3 THEN NULL ELSE 'repo' || doc_id END AS repo,
       CASE WHEN doc_id % 5 = 3 THEN 'invalid' ELSE 'valid' END AS status FROM documents""")
def q_repo_url_parse(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    forms = ["https://github.com/%s/repo%d", "HTTP://www.GitHub.com/%s/repo%d.git", " https://github.com/%s/repo%d/ ", "https://github.com/%s#repo%d", "http://github.com/%s/repo%d.git/"]
    url = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        url = F.when(F.col("doc_id") % 5 == k, F.format_string(form, "source", "doc_id")).otherwise(url)
    return d.select("doc_id", files.repo_address(url).alias("a")).select("doc_id", "a.*")


_PATHS = "CASE p_partkey % 4 WHEN 0 THEN 'src/' WHEN 1 THEN 'a/Node_Modules/' WHEN 2 THEN '' ELSE 'lib/build.d/' END || 'f' || p_partkey || CASE p_size % 7 WHEN 0 THEN '.py' WHEN 1 THEN '.min.js' WHEN 2 THEN '.TSX' WHEN 3 THEN '.txt' WHEN 4 THEN '.kt' WHEN 5 THEN '' ELSE '.h' END"
_KEPT = "p_partkey % 4 <> 1 AND p_size % 7 NOT IN (1, 3, 5)"


def _tree(spark, sf_dir):
    kind = "CASE WHEN p_partkey % 11 = 0 THEN 'tree' ELSE 'blob' END"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PATHS} AS path", f"{kind} AS type", "p_size - 3 AS size")


@query(f"SELECT p_partkey, {_PATHS} AS path, ({_KEPT}) AS wanted FROM part")
def q_path_filter(spark, sf_dir):
    return _tree(spark, sf_dir).select("p_partkey", "path", files.is_remote_source(F.col("path")).alias("wanted"))


@query(f"SELECT p_size % 7 AS kind, count(*)::BIGINT AS n_files, sum(p_size - 3)::BIGINT AS n_bytes FROM part WHERE {_KEPT} AND p_partkey % 11 <> 0 AND p_size > 3 GROUP BY ALL")
def q_candidate_bytes(spark, sf_dir):
    kept = files.candidates(_tree(spark, sf_dir))
    return kept.groupBy(((F.col("size") + 3) % 7).alias("kind")).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


@query(f"""SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'Python' WHEN 1 THEN 'JavaScript' WHEN 2 THEN 'TypeScript' WHEN 4 THEN 'Kotlin' WHEN 6 THEN 'C' ELSE 'Unknown' END AS language,
       CASE p_size % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' ELSE 'unknown' END AS validated FROM part""")
def q_language_map(spark, sf_dir):
    return _tree(spark, sf_dir).select("p_partkey", T.language(F.col("path")).alias("language"), T.validated_language(F.col("path")).alias("validated"))


@query(r"""
SELECT doc_id, (len(regexp_extract_all(b, '[\x00-\x08\x0E-\x1F]')) > 0.3 * length(b)) AND length(b) > 0 AS is_binary
FROM (SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN replace(p, ' ', repeat(chr(2), (doc_id % 9)::INT)) ELSE p END, '')[:8192] AS b FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS p FROM documents))""")
def q_binary_ratio(spark, sf_dir):
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "")
    noisy = F.replace(plain, F.lit(" "), F.repeat(F.lit("\x02"), (F.col("doc_id") % 9).cast("int")))
    content = F.coalesce(F.when(F.col("doc_id") % 3 == 0, noisy).otherwise(plain), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", files.is_binary(content.cast("binary")).alias("is_binary"))


@query("""
SELECT o_orderkey, CASE WHEN k IS NOT NULL AND e IS NOT NULL THEN l || ' ' || lower(k) || ': ' || e WHEN k IS NOT NULL THEN l || ' ' || lower(k) WHEN e IS NOT NULL THEN l || ' bug: ' || e ELSE l || ' bug' END AS bug_description
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS e, CASE WHEN o_orderkey % 5 = 0 THEN 'java' ELSE 'code' END AS l FROM orders WHERE o_orderkey % 7 <> 0)""")
def q_kb_records(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    rows = o.select("o_orderkey", F.when(key % 7 == 0, F.lit("  ")).otherwise("x = 1").alias("buggy_code"), F.when(key % 2 == 0, F.col("o_orderpriority")).alias("bug_type"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("error"), F.when(key % 5 == 0, "java").alias("language"), F.lit(None).cast("string").alias("bug_description"))
    return knowledge.complete(rows).select("o_orderkey", "bug_description")


@query("SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k <= 200")
def q_cap_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value IS NOT NULL")
    return knowledge.first_per_group(rows, "event_type", "event_id", 200).select("event_type", "event_id")


@query(r"""
SELECT conv_id, turn, trim(array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, '-') AND NOT starts_with(x, '---')), lambda x: x[2:]), chr(10)), E' \n\t\r') AS buggy,
       trim(array_to_string(list_transform(list_filter(l, lambda x: starts_with(x, '+') AND NOT starts_with(x, '+++')), lambda x: x[2:]), chr(10)), E' \n\t\r') AS fixed
FROM (SELECT conv_id, turn, string_split('--- a' || chr(10) || '+++ b' || chr(10) || CASE WHEN turn % 2 = 0 THEN '-' ELSE '+' END || replace(text, chr(10), chr(10) || '+'), chr(10)) AS l FROM conversations)""")
def q_patch_split(spark, sf_dir):
    sign = F.when(F.col("turn") % 2 == 0, "-").otherwise("+")
    patch = F.concat(F.lit("--- a\n+++ b\n"), sign, F.replace("text", F.lit("\n"), F.lit("\n+")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", knowledge.patch_side(patch, "-").alias("buggy"), knowledge.patch_side(patch, "+").alias("fixed"))


@query("""SELECT event_id, event_type AS kind, 'u=' || user_id AS user_of, NULL::VARCHAR AS missing FROM events""")
def q_info_parse(spark, sf_dir):
    text = F.format_string('kind = "old"\nuser = "u=%d"\nno pair\nkind= %s ', "user_id", "event_type")
    return table(spark, sf_dir, "events").select("event_id", knowledge.info(text).alias("m")).select("event_id", F.col("m")["kind"].alias("kind"), F.col("m")["user"].alias("user_of"), F.col("m")["absent"].alias("missing"))


@query(r"""
SELECT d.doc_id, concat_ws(chr(10), nullif(trim(d.source), ''), CASE WHEN l.quality = 0 THEN 'Error: low' END, CASE WHEN l.toxic = 1 THEN 'Type: toxic' END, 'Language: ' || d.lang) AS embedded
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def q_embedding_text(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    return rows.select("doc_id", T.record_text(F.col("source"), F.when(F.col("quality") == 0, "low"), F.when(F.col("toxic") == 1, " toxic "), F.col("lang"), none, F.lit("  ")).alias("embedded"))


@query(r"""
SELECT conv_id, 'Artifact type: issue' || chr(10) || 'Number: ' || conv_id || chr(10) || 'Labels: ' || string_agg(DISTINCT role, chr(10) ORDER BY role) || chr(10) || 'Comments: ' ||
       string_agg(replace(trim(text, E' \n\t\r'), chr(10), ' '), chr(10) ORDER BY turn, text) FILTER (k <= 20) AS artifact
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE trim(text) <> '') GROUP BY conv_id""")
def q_artifact_text(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("trim(text) <> ''")
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("t")))), lambda x: F.replace(T.safe_text(x["t"]), F.lit("\n"), F.lit(" ")))
    grouped = rows.groupBy("conv_id").agg(said.alias("comments"), F.array_sort(F.collect_set("role")).alias("labels"))
    none = F.lit(None).cast("string")
    return grouped.select("conv_id", history.artifact_text(F.lit("issue"), F.col("conv_id"), none, none, F.col("labels"), none, F.col("comments"), none).alias("artifact"))


_ISSUES = "o_custkey % 50 AS repo, o_orderkey AS number, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS updated_at"


def _orders(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("repo"), F.col("o_orderkey").alias("number"), stamp.alias("updated_at"), (F.col("o_orderstatus") == "O").alias("is_pull_request"), F.when(F.col("o_orderstatus") == "F", stamp).alias("merged_at"), F.repeat("o_orderpriority", F.lit(3000)).alias("patch"))


@query(f"SELECT repo, number, updated_at, k::INT AS position FROM (SELECT {_ISSUES}, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'O') WHERE k <= 30")
def q_issue_filter(spark, sf_dir):
    return history.issues(_orders(spark, sf_dir)).select("repo", "number", "updated_at", "position")


@query(f"""
SELECT repo, number, merged, least(30000, n)::INT AS patch_chars, row_number() OVER (PARTITION BY repo ORDER BY NOT merged, updated_at, number)::INT AS position
FROM (SELECT {_ISSUES}, o_orderstatus = 'F' AS merged, length(o_orderpriority) * 3000 AS n, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k <= 30""")
def q_pr_order(spark, sf_dir):
    return history.pull_requests(_orders(spark, sf_dir)).select("repo", "number", "merged", F.char_length("patch").alias("patch_chars"), "position")


@query(r"""
SELECT doc_id, i::INT AS line, trim(l[i]) AS text FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT doc_id, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS l FROM documents WHERE text IS NOT NULL))""")
def q_line_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines_of(F.col("text"))).alias("p", "t"))
    return rows.select("doc_id", (F.col("p") + 1).alias("line"), F.trim("t").alias("text"))


@query("""
SELECT lang, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS texts, min(doc_id) AS first_id FROM documents GROUP BY lang""")
def q_first_copies(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts"), F.min("doc_id").alias("first_id"))


STOP_WORDS = ["the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "are", "was", "be", "by", "at", "or", "an", "this"]


@query(r"""
WITH w AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS term FROM documents),
c AS (SELECT term, count(*)::BIGINT AS total, count(DISTINCT item_id)::BIGINT AS docs FROM w WHERE length(term) > 1 AND term NOT IN (""" + ", ".join(f"'{w}'" for w in STOP_WORDS) + r""") GROUP BY term ORDER BY total DESC, term LIMIT 5000)
SELECT term, total, docs, round(ln((1.0 + (SELECT count(*) FROM documents)) / (1 + docs)) + 1, 6) AS idf FROM c""")
def q_tfidf_fit(spark, sf_dir):
    return retrieval.tf_idf_vocabulary(table(spark, sf_dir, "documents"), STOP_WORDS).withColumn("idf", F.round("idf", 6))


@query("""
WITH p AS (SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p)
SELECT query_id, vec_id, round(greatest(0, least(1, s)), 5) AS similarity, rank::INT AS rank FROM k WHERE rank <= 3 AND s > 0.05""")
def q_topk_dataset(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    hits = retrieval.top_k(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), e, 3)
    return hits.select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"), "rank")


@query("""
WITH p AS (SELECT q.vec_id AS query_id, r.vec_id, r.vec_id % 2 AS half, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, half ORDER BY s DESC, vec_id) AS rank FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY least(1, s) DESC, half, rank) AS position FROM k WHERE rank <= 4 AND s > 0.05)
SELECT query_id, vec_id, half::INT AS source_ord, position::INT AS position FROM m WHERE position <= 6""")
def q_topk_merge(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.merged([retrieval.top_k(queries, e.where(f"vec_id % 2 = {half}"), 4) for half in (0, 1)]).select("query_id", "vec_id", "source_ord", "position")


@query("SELECT count(*)::BIGINT AS records, max(len(embedding))::INT AS dimension, min(len(embedding)) = max(len(embedding)) AS consistent, round(max(abs(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) - 1)), 3) AS off_unit FROM embeddings")
def q_retriever_status(spark, sf_dir):
    off = F.round(F.max(F.abs(norm(F.col("embedding")) ** 2 - 1)), 3).alias("off_unit")
    return retrieval.status(table(spark, sf_dir, "embeddings"), "embedding", off)
