"""The test tables as the engine's entities, and the same as SQL for the oracles.

Inline rows are written once and serve both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: one small file is one task otherwise, a large table is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def values(data: list[tuple], name: str, columns: str) -> str:
    """A SQL common table of the inline rows."""

    def lit(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(lit, v)) + "]::VARCHAR[]"
        return "'" + v.replace("'", "''").replace("\0", "' || chr(0) || '") + "'"

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in data) + ")"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return d.select("doc_id", path.alias("path"), F.col("text").alias("content"), T.sha(F.col("text")).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


SOURCES = "sources AS (SELECT doc_id, source || '/' || doc_id || '.md' AS path, text AS content, sha256(text) AS content_hash, octet_length(encode(text))::BIGINT AS size_bytes FROM documents)"

#: The state of the index before: some sources missing, some with another hash, and some that are gone now.
OLD = """old AS (SELECT path, CASE WHEN doc_id % 5 = 0 THEN sha256('old' || path) ELSE content_hash END AS content_hash FROM sources WHERE doc_id % 7 <> 0
 UNION ALL SELECT 'gone/' || item_id || '.md', sha256(text) FROM benchmark)"""


def old_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).where("doc_id % 7 <> 0")
    kept = s.select("path", F.when(F.col("doc_id") % 5 == 0, T.sha(F.concat(F.lit("old"), "path"))).otherwise(F.col("content_hash")).alias("content_hash"))
    b = table(spark, sf_dir, "benchmark")
    return kept.unionByName(b.select(F.concat(F.lit("gone/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), T.sha(F.col("text")).alias("content_hash")))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "active").when((F.col("quality") == 0) & (F.col("toxic") == 0), "stale").when(F.col("quality") == 1, "conflicted").otherwise("rejected")
    kind = F.element_at(F.array(*map(F.lit, ("constraint", "decision", "lesson", "issue"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return d.join(lab, "doc_id").select(
        F.concat(F.lit("m"), F.col("doc_id").cast("string")).alias("id"), kind.alias("type"), F.concat(F.lit("Note "), F.col("doc_id").cast("string"), F.lit(" from "), "source").alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("string").alias("reason"), status.alias("status"), F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("source")).alias("scope"), F.col("doc_id").alias("updated_at"),
    )


MEMORIES = """memories AS (SELECT 'm' || doc_id AS id, ['constraint', 'decision', 'lesson', 'issue'][doc_id % 4 + 1] AS type, 'Note ' || doc_id || ' from ' || source AS title, text AS content, NULL::VARCHAR AS reason,
 CASE WHEN quality = 1 AND toxic = 0 THEN 'active' WHEN quality = 0 AND toxic = 0 THEN 'stale' WHEN quality = 1 THEN 'conflicted' ELSE 'rejected' END AS status,
 CASE WHEN doc_id % 3 = 0 THEN []::VARCHAR[] ELSE [source] END AS scope, doc_id AS updated_at FROM documents JOIN labels USING (doc_id))"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "in_progress").when(F.col("o_orderstatus") == "F", "completed").otherwise("cancelled")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("goal"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))


TASKS = "tasks AS (SELECT o_orderkey AS id, o_orderpriority AS goal, CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'completed' ELSE 'cancelled' END AS status, o_orderdate AS updated_at FROM orders)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part")
    file = F.concat(F.lit("suppliers/"), F.col("s_nationkey").cast("string"), F.lit(".ts"))
    name = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    a = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), file.alias("path"), name.alias("name"), F.concat(file, F.lit("#"), name).alias("qualified_name"), F.col("s_name").alias("signature"), F.col("s_suppkey").alias("start_line"))
    key = F.col("p_partkey").cast("string")
    b = p.select(F.concat(F.lit("p"), key).alias("id"), F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.concat("p_brand", F.lit("#"), "p_name", F.lit("#"), key).alias("qualified_name"), F.col("p_type").alias("signature"), F.col("p_partkey").alias("start_line"))
    return a.unionByName(b)


SYMBOLS = """symbols AS (SELECT 's' || s_suppkey AS id, 'suppliers/' || s_nationkey || '.ts' AS path, 'S' || s_suppkey AS name, 'suppliers/' || s_nationkey || '.ts#S' || s_suppkey AS qualified_name, s_name AS signature, s_suppkey AS start_line FROM supplier
 UNION ALL SELECT 'p' || p_partkey, p_brand, p_name, p_brand || '#' || p_name || '#' || p_partkey, p_type, p_partkey FROM part)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, p, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    met = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(p.select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sup = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    to = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("api."), sup)).when(F.col("l_returnflag") == "R", F.concat(F.lit("suppliers/"), F.col("s_nationkey").cast("string"), F.lit(".ts#"), sup)).when(F.col("l_linenumber") % 2 == 1, F.col("p_name")).otherwise(F.lit("small ring"))
    kind = F.when(F.col("l_returnflag") == "A", "CALLS").when(F.col("l_returnflag") == "R", "EXTENDS").otherwise("IMPORTS")
    return met.select(F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit(":"), F.col("l_suppkey").cast("string")).alias("id"), F.col("p_brand").alias("path"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from_id"), to.alias("to_name"), kind.alias("relation_type"), F.col("l_linenumber").alias("start_line"))


RELATIONS = """relations AS (SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, p_brand AS path, 'p' || l_partkey AS from_id,
 CASE WHEN l_returnflag = 'A' THEN 'api.S' || l_suppkey WHEN l_returnflag = 'R' THEN 'suppliers/' || s_nationkey || '.ts#S' || l_suppkey WHEN l_linenumber % 2 = 1 THEN p_name ELSE 'small ring' END AS to_name,
 CASE l_returnflag WHEN 'A' THEN 'CALLS' WHEN 'R' THEN 'EXTENDS' ELSE 'IMPORTS' END AS relation_type, l_linenumber AS start_line
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""


def graph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols(spark, sf_dir).select("path").distinct()


#: Relations with their target, by the same precedence as the engine's.
RESOLVED = """grouped AS (SELECT path, from_id, to_name, relation_type, count(*) AS n FROM relations GROUP BY ALL),
 short AS (SELECT *, list_last(string_split_regex(to_name, '[.#]')) AS s FROM grouped),
 q AS (SELECT qualified_name, max(id) AS id, arg_max(path, id) AS path FROM symbols GROUP BY 1),
 f AS (SELECT name, path, min(id) AS id FROM symbols GROUP BY 1, 2),
 u AS (SELECT name, min(id) AS id, min(path) AS path FROM symbols GROUP BY 1 HAVING count(*) = 1),
 resolved AS (SELECT coalesce(c.path, r.path) AS path, r.from_id, r.to_name, r.relation_type, r.n, coalesce(q.id, f.id, u.id) AS target_id,
  CASE WHEN q.id IS NOT NULL THEN q.path WHEN f.id IS NOT NULL THEN f.path ELSE u.path END AS target_path
  FROM short r LEFT JOIN q ON q.qualified_name = r.to_name LEFT JOIN f ON f.name = r.s AND f.path = r.path LEFT JOIN u ON u.name = r.s LEFT JOIN symbols c ON c.id = r.from_id)"""


def grouped_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations(spark, sf_dir).groupBy("path", "from_id", "to_name", "relation_type").agg(F.count("*").alias("n"))


ASKED = [(1001, "red widget"), (1002, "small ring"), (1003, "note src3 S7"), (1004, "!!! ...")]


def queries(spark: SparkSession, sf_dir: str, more: bool = False) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return b.unionByName(rows(spark, ASKED, "query_id long, query string")) if more else b


QUERIES = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
MORE_QUERIES = values(ASKED, "asked", "query_id, query") + ", queries AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM asked)"

#: Greedy chunks, line by line.
CHUNKS = """split_lines AS (SELECT path, content, string_split_regex(content, '\\r?\\n') AS ls FROM sources),
 each_line AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM split_lines),
 fold AS (SELECT path, n, length(line) + 1 AS used, 0 AS chunk_no FROM each_line WHERE n = 1
  UNION ALL SELECT e.path, e.n, CASE WHEN f.used + length(e.line) + 1 <= 4000 THEN f.used + length(e.line) + 1 ELSE length(e.line) + 1 END,
   CASE WHEN f.used + length(e.line) + 1 <= 4000 THEN f.chunk_no ELSE f.chunk_no + 1 END FROM fold f JOIN each_line e ON e.path = f.path AND e.n = f.n + 1),
 chunks AS (SELECT path, chunk_no, min(n)::INT AS start_line, max(n)::INT AS end_line, string_agg(line, chr(10) ORDER BY n) AS content FROM fold JOIN each_line USING (path, n) GROUP BY path, chunk_no)"""

CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]"


def grams_sql(text: str) -> str:
    """The distinct grams of a SQL expression, as a list."""
    return (
        f"list_distinct(list_concat("
        f"flatten(list_transform(regexp_extract_all(lower({text}), '{CJK}+'), lambda t: list_concat("
        f"list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))))), "
        f"flatten(list_transform(list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_-]+'), lambda t: NOT regexp_matches(t, '{CJK}') AND length(t) <= 128), "
        f"lambda t: CASE WHEN length(t) < 3 THEN [t] ELSE list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)) END))))"
    )


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(translate(lower({text}), '{T.MARKED}', '{T.PLAIN}'), '{T.FTS_TOKEN}')"


PHRASES = "qt AS (SELECT query_id, t, count(*) AS again FROM (SELECT query_id, unnest(" + tokens_sql("regexp_replace(query, '[^\\p{L}\\p{N}_\\s-]', '', 'g')") + ") AS t FROM queries) GROUP BY ALL)"


def bm25_sql(name: str, items: str, weights: dict[str, float]) -> str:
    """Common tables that end in {name}_bm25 (query_id, id, bm25), for phrases of one token."""
    post = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest({tokens_sql(f'coalesce({c}, {chr(39)}{chr(39)})')}) AS t FROM {items}" for c, w in weights.items())
    return f"""{name}_post AS ({post}), {name}_len AS (SELECT id, count(*) AS d FROM {name}_post GROUP BY id),
 {name}_tf AS (SELECT id, t, sum(w) AS tf FROM {name}_post WHERE t IN (SELECT t FROM qt) GROUP BY id, t), {name}_df AS (SELECT t, count(*) AS df FROM {name}_tf GROUP BY t),
 {name}_stat AS (SELECT (SELECT count(*) FROM {items}) AS r, (SELECT count(*) FROM {name}_post) AS k),
 {name}_bm25 AS (SELECT query_id, id, round(-sum(again * CASE WHEN ln((r - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((r - df + 0.5) / (df + 0.5)) END * tf::DOUBLE * 2.2::DOUBLE
  / (tf::DOUBLE + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d / (k::DOUBLE / r)))), 9) AS bm25
  FROM {name}_tf JOIN {name}_df USING (t) JOIN qt USING (t) JOIN {name}_len USING (id), {name}_stat GROUP BY query_id, id)"""
