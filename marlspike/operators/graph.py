"""The relation graph: name resolution, file edges, overview, neighbours, details and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..store import settled

# Extensions tried for a relative import, in order.
IMPORT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]


def folded(path: Column) -> Column:
    """A posix path without . and .. parts."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")

    def step(acc, p):
        up = (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.element_at(acc, -1), F.lit("")) != "..")
        return F.when(up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))

    return F.array_join(F.aggregate(F.when(F.size(parts) > 0, parts).otherwise(start), start, step), "/")


def resolved(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds target_id and target_path (null if unresolved) and the source path of the calling symbol.

    Precedence: qualified name, then a symbol of that short name in the same file, then the only symbol of that name.
    Where several fit, the largest id for a qualified name and the smallest within a file. Names are aggregated before
    the joins, so a name that many symbols share adds one row.
    """
    s = symbols.select("id", "path", "name", "qualified_name")
    qualified = s.groupBy(F.col("qualified_name").alias("q_name")).agg(F.max("id").alias("q_id"), F.max_by("path", "id").alias("q_path"))
    in_file = s.groupBy(F.col("name").alias("f_name"), F.col("path").alias("f_path")).agg(F.min("id").alias("f_id"))
    unique = s.groupBy(F.col("name").alias("u_name")).agg(F.count("*").alias("u_n"), F.min("id").alias("u_id"), F.min("path").alias("u_path")).where("u_n = 1").drop("u_n")
    callers = s.select(F.col("id").alias("c_id"), F.col("path").alias("c_path"))
    short = F.element_at(F.split("to_name", "[.#]"), -1)
    out = relations.withColumn("_short", short)
    out = out.join(qualified, out.to_name == F.col("q_name"), "left")
    out = out.join(in_file, (F.col("_short") == F.col("f_name")) & (F.col("path") == F.col("f_path")), "left")
    out = out.join(unique, F.col("_short") == F.col("u_name"), "left").join(callers, F.col("from_id") == F.col("c_id"), "left")
    target_path = F.when(F.col("q_id").isNotNull(), F.col("q_path")).when(F.col("f_id").isNotNull(), F.col("f_path")).otherwise(F.col("u_path"))
    return out.select(*[c for c in relations.columns if c != "path"], F.coalesce("c_path", "path").alias("path"), F.coalesce("q_id", "f_id", "u_id").alias("target_id"), target_path.alias("target_path"))


def import_paths(relations: DataFrame, sources: DataFrame) -> DataFrame:
    """key, import_path of relative imports that name an indexed file: the first candidate that exists.

    relations: key, path, to_name, relation_type."""
    base = folded(F.concat_ws("/", F.regexp_replace(F.regexp_replace("path", r"\\", "/"), "/?[^/]*$", ""), "to_name"))
    rows = relations.where("relation_type = 'IMPORTS' and startswith(to_name, '.')").select("key", base.alias("base"))
    bare = F.regexp_replace("base", r"(?<=[^/])\.[^./]*$", "")
    tries = F.array(F.col("base"), bare, *[F.concat(bare, F.lit(x)) for e in IMPORT_EXTENSIONS for x in (e, f"/index{e}")])
    rows = rows.select("key", F.posexplode(tries).alias("turn", "candidate"))
    hit = rows.join(sources.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy("key").agg(F.min_by("candidate", "turn").alias("import_path"))


def file_edges(found: DataFrame, by: str = "n") -> DataFrame:
    """source, target, relation_type, n of resolved relations between different files; `by` holds how many a row stands for."""
    n = F.sum(by) if by in found.columns else F.count("*")
    return found.where("target_path is not null and target_path <> path").groupBy(F.col("path").alias("source"), F.col("target_path").alias("target"), "relation_type").agg(n.alias("n"))


def overview(sources: DataFrame, symbols: DataFrame, edges: DataFrame, limit: int = 80, most_edges: int = 400) -> tuple[DataFrame, DataFrame]:
    """Nodes (path, degree, n_symbols, rank) by degree, symbols and path; edges among them by count."""
    limit = max(10, min(120, limit))
    ends = edges.select(F.explode(F.array("source", "target")).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("degree"))
    counts = symbols.groupBy("path").agg(F.count("*").alias("n_symbols"))
    nodes = sources.select("path").join(ends, "path", "left").join(counts, "path", "left").select("path", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"), F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols"))
    nodes = nodes.orderBy(F.desc("degree"), F.desc("n_symbols"), "path").limit(limit)
    chosen = edges.join(nodes.select(F.col("path").alias("source")), "source", "left_semi").join(nodes.select(F.col("path").alias("target")), "target", "left_semi")
    return nodes, chosen.orderBy(F.desc("n"), "source", "target", "relation_type").limit(most_edges)


def overview_report(sources: DataFrame, relations: DataFrame, edges: DataFrame, limit: int = 80, most_edges: int = 400, by: str = "n") -> DataFrame:
    """One row: nodes, edges (all of them), truncated (whether an overview leaves some out), types (relations by type, unfiltered).

    edges: file_edges() of the relations that the overview shows; relations: all of them.
    """
    limit = max(10, min(120, limit))
    shown, kept = overview(sources, sources.select("path").limit(0), edges, limit, most_edges)
    n = F.sum(by) if by in relations.columns else F.count("*")
    types = relations.groupBy("relation_type").agg(n.alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation_type", "n")))).alias("types"))  # a row a type
    totals = sources.select("path").distinct().agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    parts = shown.agg(F.count("*").alias("_shown")).crossJoin(kept.agg(F.count("*").alias("_kept")))
    return totals.crossJoin(parts).crossJoin(types).select("nodes", "edges", ((F.col("_shown") < F.col("nodes")) | (F.col("_kept") < F.col("edges"))).alias("truncated"), "types")  # single rows


def of_types(found: DataFrame, types: list[str] | None) -> DataFrame:
    """The relations of some types (all, if none are named)."""
    return found.where(F.col("relation_type").isin(types)) if types else found


def neighbours(found: DataFrame, symbols: DataFrame, seed: str, depth: int = 1, limit: int = 100, types: list[str] | None = None) -> DataFrame:
    """id, hop of the symbols within one or two hops of a symbol or `file:path`, over resolved relations, both ways.

    A hop keeps the nodes with the least relation id first; of a file the symbols of highest degree are the seeds.
    """
    limit, depth = max(10, min(150, limit)), max(1, min(2, depth))
    links = of_types(found, types).where("from_id is not null and target_id is not null").select(F.col("id").alias("rel"), F.col("from_id").alias("a"), F.col("target_id").alias("b"))
    both = settled(links.unionByName(links.select("rel", F.col("b").alias("a"), F.col("a").alias("b"))))  # each hop reads it
    if seed.startswith("file:"):
        degree = both.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"))
        near = symbols.where(F.col("path") == seed[5:]).select("id").join(degree, "id", "left").orderBy(F.desc(F.coalesce("degree", F.lit(0))), "id").limit(min(30, limit)).select("id")
    else:
        near = symbols.where(F.col("id") == seed).select("id")
    got = near.select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("via"))
    for hop in range(1, depth + 1):
        front = got.where(F.col("hop") == hop - 1).select(F.col("id").alias("a"))
        fresh = both.join(front, "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min(F.col("rel").cast("string")).alias("via"))
        fresh = fresh.join(got.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), "via")
        got = settled(got.unionByName(fresh))
    order = Window.orderBy("hop", "via", "id")
    return got.orderBy("hop", "via", "id").limit(limit).withColumn("place", F.row_number().over(order)).select("id", "hop", "place")


def induced_edges(found: DataFrame, nodes: DataFrame, limit: int = 500, types: list[str] | None = None) -> DataFrame:
    """The first `limit` relations by id whose ends are both among the nodes."""
    ids = nodes.select("id")
    out = of_types(found, types).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return out.orderBy("id").limit(limit)


def search(symbols: DataFrame, sources: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Symbols whose name or qualified name holds the text (exact, then prefix, then the rest, by name), then files by path."""
    q = query.strip()
    if not q:
        return symbols.limit(0).select(F.lit("symbol").alias("node"), "id", F.col("name").alias("label"), "path", F.lit(0).alias("place"))
    low = F.lit(q.lower())
    has = lambda c: F.contains(F.lower(c), low)
    order = F.when(F.col("name") == q, 0).when(F.startswith(F.lower("name"), low), 1).otherwise(2)
    s = symbols.where(has(F.col("name")) | has(F.col("qualified_name"))).select(F.lit("symbol").alias("node"), "id", F.col("name").alias("label"), "path", F.lit(0).alias("class"), order.alias("o"), F.col("name").alias("k"))
    s = s.orderBy("o", "k", "id").limit(limit)
    f = sources.where(has(F.col("path"))).select(F.lit("file").alias("node"), F.concat(F.lit("file:"), F.col("path")).alias("id"), T.basename(F.col("path")).alias("label"), "path", F.lit(1).alias("class"), F.lit(0).alias("o"), F.col("path").alias("k"))
    both = s.unionByName(f.orderBy("k").limit(limit)).orderBy("class", "o", "k", "id").limit(limit)
    return both.withColumn("place", F.row_number().over(Window.orderBy("class", "o", "k", "id"))).select("node", "id", "label", "path", "place")


def node_details(symbols: DataFrame, relations: DataFrame, ids: DataFrame, limit: int = 20) -> DataFrame:
    """id, side (out or in), place, relation: of each symbol the first relations out of it by line, and those that name it.

    Relations are cut to the first of each name before they meet the symbols of that name, so that a name which many
    symbols and relations share does not make a row of each pair.
    """
    want = symbols.join(ids.select("id"), "id", "left_semi").select("id", "name", "qualified_name")
    r = relations.select(F.col("id").alias("rel"), "from_id", "to_name", "path", "start_line")
    out = want.join(r, want.id == r.from_id).select(want.id, F.lit("out").alias("side"), "rel", F.lit("").alias("p"), "start_line")
    first = Window.partitionBy("to_name").orderBy("path", "start_line", "rel")
    named = r.drop("from_id").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)
    names = want.select("id", F.explode(F.array_distinct(F.array("name", "qualified_name"))).alias("to_name"))
    into = names.join(named, "to_name").select("id", F.lit("in").alias("side"), "rel", F.col("path").alias("p"), "start_line")
    order = Window.partitionBy("id", "side").orderBy("p", "start_line", "rel")
    return out.unionByName(into).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("id", "side", "place", F.col("rel").alias("relation"))


#: Symbols that a file's details name.
FILE_SYMBOLS = 30


def file_details(symbols: DataFrame, relations: DataFrame, path: str | None = None, by: str = "n") -> DataFrame:
    """path, n_symbols, n_relations, symbols (the first 30 by line: start_line, id, name, kind) of each file, or of one.

    The first symbols of a file are picked by a window whose limit applies before its shuffle, so a large file sends few.
    """
    if path is not None:
        symbols, relations = symbols.where(F.col("path") == path), relations.where(F.col("path") == path)
    n = F.sum(by) if by in relations.columns else F.count("*")
    counts = symbols.groupBy("path").agg(F.count("*").alias("n_symbols"))
    out = relations.groupBy(F.col("path").alias("r_path")).agg(n.alias("n_relations"))
    order = Window.partitionBy("path").orderBy("start_line", "id")
    first = symbols.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= FILE_SYMBOLS)
    first = first.groupBy(F.col("path").alias("s_path")).agg(F.array_sort(F.collect_list(F.struct("start_line", "id", "name", "kind"))).alias("symbols"))
    met = counts.join(out, F.col("path") == F.col("r_path"), "full_outer").join(first, F.col("path") == F.col("s_path"), "left")
    zero = F.lit(0).cast("long")
    return met.select(F.coalesce("path", "r_path").alias("path"), F.coalesce("n_symbols", zero).alias("n_symbols"), F.coalesce("n_relations", zero).alias("n_relations"), "symbols")
