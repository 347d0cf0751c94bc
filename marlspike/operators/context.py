"""Context assembly: ranking records against a task, slots, and fitting a token budget."""

from __future__ import annotations

import json
import re
from heapq import heapify, heapreplace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..store import settled

# How many of each slot a context holds, and the order in which lists give way.
SLOTS = {"constraint": 20, "decision": 15, "lesson": 10}
CANDIDATES, HITS, USER_MEMORIES, TASKS, TASKS_READ, SYMBOLS, RELATIONS = 64, 24, 50, 10, 20, 12, 40
DROP_ORDER = ["relevant", "codeRelations", "lessons", "decisions", "constraints", "userMemories", "activeTasks"]
REMOVED = "The token budget left no room for details; they were left out."


def matches(tokens: Column, text: Column) -> Column:
    """How many of the tokens (repeats count) stand in the lower-cased text."""
    return F.size(F.filter(tokens, lambda t: F.contains(F.lower(text), t)))


def memory_candidates(hits: DataFrame, memories: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """query_id, id, relevant: the active memories that a search found, filled up with the newest to `limit`."""
    active = memories.where("status = 'active'").select("id", "updated_at")
    newest = active.orderBy(F.desc("updated_at"), "id").limit(limit)  # `limit` rows
    queries = hits.select("query_id").distinct()
    found = hits.where("kind = 'memory'").select("query_id", "id").join(active, "id").select("query_id", "id", "updated_at", F.lit(True).alias("relevant"))
    fill = queries.withColumn("one", F.lit(1)).join(F.broadcast(newest.withColumn("one", F.lit(1))), "one")  # bound: `limit` rows
    fill = fill.select("query_id", "id", "updated_at", F.lit(False).alias("relevant"))
    both = found.unionByName(fill).groupBy("query_id", "id").agg(F.max("relevant").alias("relevant"), F.max("updated_at").alias("updated_at"))
    order = Window.partitionBy("query_id").orderBy(F.desc("relevant"), F.desc("updated_at"), "id")
    return both.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("query_id", "id", "relevant")


def ranked(candidates: DataFrame, memories: DataFrame, tasks: DataFrame) -> DataFrame:
    """candidates: query_id, id, relevant; tasks: query_id, query. Adds rank: 100 if relevant plus the task's words that a memory holds."""
    text = F.concat_ws(" ", "title", "content", F.array_join("scope", " "))
    rows = candidates.join(memories, "id").join(tasks, "query_id")
    return rows.withColumn("rank", F.when(F.col("relevant"), 100).otherwise(0) + matches(T.text_tokens(F.col("query")), text))


def slots(rows: DataFrame) -> DataFrame:
    """query_id, slot, place, id, rank: constraints without scope always, anything else only with a rank above zero."""
    slot = F.when(F.col("type") == "constraint", "constraint").when(F.col("type") == "decision", "decision").when(F.col("type").isin("lesson", "issue"), "lesson")
    rows = rows.withColumn("slot", slot).where(F.col("slot").isNotNull() & ((F.col("rank") > 0) | ((F.col("slot") == "constraint") & (F.size("scope") == 0))))
    order = Window.partitionBy("query_id", "slot").orderBy(F.desc("rank"), "id")
    cap = F.coalesce(*[F.when(F.col("slot") == s, F.lit(n)) for s, n in SLOTS.items()])
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("query_id", "slot", "place", "id", "rank")


def user_memory_rank(tokens: Column) -> Column:
    text = F.concat_ws(" ", "title", "content", F.coalesce("scope_ref", F.lit("")))
    return 100 * matches(tokens, text) + F.when(F.col("scope_level") == "user", 1).otherwise(10) + F.when(F.col("type") == "constraint", 5).otherwise(0)


def task_rank(tasks: DataFrame, query: str, read: int = TASKS_READ, keep: int = TASKS) -> DataFrame:
    """The `read` newest tasks in progress, by the query's words in their JSON, then by time: id, matches, place."""
    newest = tasks.where("status = 'in_progress'").orderBy(F.desc("updated_at"), "id").limit(read)
    tokens = T.text_tokens(F.lit(query))
    rows = newest.withColumn("matches", matches(tokens, F.to_json(F.struct(*tasks.columns))))
    order = Window.orderBy(F.desc("matches"), F.desc("updated_at"), "id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("id", "matches", "place")


def code_relations(hits: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, place, id: the relations of the first symbol hits, by path and line."""
    first = Window.partitionBy("query_id").orderBy("rank")
    seeds = hits.where("kind = 'symbol'").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= SYMBOLS).select("query_id", F.col("id").alias("from_id"))
    order = Window.partitionBy("query_id").orderBy("path", "start_line", "id")
    return relations.join(seeds, "from_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= RELATIONS).select("query_id", "place", "id")


def budget_prefix(items: DataFrame, budget: Column, by: list[str], order: list[Column], cost: str = "tokens") -> DataFrame:
    """The first phase of fitting: items whose running cost, in order of worth, stays within the budget; the first stays anyway.

    Adds used and place. Two-level prefix sums: the rows are sorted by range over the cluster, whatever their keys; the sums
    of each key's piece of each range give where its running cost begins, and rows run within their piece alone. Pieces that
    begin beyond the budget are dropped before. So a key may have any share of the rows. Make the order total; costs are
    not negative (a null costs nothing).
    """
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.repartitionByRange(n, *by, *order).withColumn("_piece", F.spark_partition_id())
    rows = settled(rows.withColumn("_budget", budget))
    pieces = rows.groupBy(*by, "_piece").agg(F.sum(F.coalesce(cost, F.lit(0))).alias("_sum"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a range at most
    begin = pieces.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_piece").alias("_p"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_begin"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_past"))
    on = F.col("_piece") == F.col("_p")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = rows.join(begin, on).where((F.col("_begin") <= F.col("_budget")) | (F.col("_past") == 0))
    w = Window.partitionBy(*by, "_piece").orderBy(*order)
    used = F.col("_begin") + F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    place = (F.col("_past") + F.row_number().over(w)).cast("int")
    out = met.withColumn("used", used).withColumn("place", place).where((F.col("used") <= F.col("_budget")) | (F.col("place") == 1))
    return out.select(*items.columns, "used", "place")


CJK = re.compile("[⺀-⿟々〇〡-〩〸-〻ぁ-ゖゝ-ゟァ-ヺヽ-ヿㄱ-ㆎㇰ-ㇿ㐀-䶿一-鿿ꥠ-ꥼ가-힣豈-﫿ｦ-ﾝ\U0001b000-\U0001b16f\U00020000-\U0003134f]")


def quarters(value: str) -> int:
    """Four times the tokens of a text: one for each UTF-16 unit, four for a CJK character."""
    return len(value.encode("utf-16-le")) // 2 + 3 * len(CJK.findall(value))


def estimate(value: str) -> int:
    return -(-quarters(value) // 4)


def compact(context: dict) -> str:
    return json.dumps(context, ensure_ascii=False, separators=(",", ":"))


#: Where texts that may be shortened lie: a list, then the fields of a record; of a checkpoint, fields and lists.
TEXTS = [("relevant", ["content"]), *[(name, ["content", "reason"]) for name in ("constraints", "decisions", "lessons", "userMemories")], ("activeTasks", ["goal"])]
CHECKPOINT_LISTS = ["completed", "next", "changedFiles", "blockers", "risks"]


def _spots(context: dict):
    """(owner, key) of every text that may be shortened, in order."""
    for name, fields in TEXTS:
        for record in context[name]:
            yield from ((record, f) for f in fields if record.get(f))
            if held := record.get("checkpoint") if name == "activeTasks" else None:
                yield from [(held, "summary")] if held.get("summary") else []
                for items in (held.get(k) or [] for k in CHECKPOINT_LISTS):
                    yield from ((items, i) for i in range(len(items)))


def fit_budget(context: dict, budget: int) -> dict:
    """Fits one assembled context (at most some 150 records) into a budget; a driver step on a small object.

    The context is written once; from then on only what goes is subtracted. Lists lose their tails down to one record in
    DROP_ORDER, then a heap of lengths gives the longest text to be cut to 70 %, again and again, and at last all lists
    are emptied with a warning. context is changed and returned.
    """
    state = context["budget"] = {"requestedTokens": budget, "usedTokens": 0, "truncated": False}
    size = quarters(compact(context)) - 1  # without the number of tokens, which stands in the text itself

    def over(less: int = 0) -> bool:
        nonlocal size
        size -= less
        state["usedTokens"] = -(-(size + len(str(state["usedTokens"]))) // 4)
        return state["usedTokens"] > budget

    if not over():
        return context
    state["truncated"], size, much = True, size - 1, True  # one letter less than "false"
    for name in DROP_ORDER:
        costs = [quarters(compact(record)) + 1 for record in context[name][1:]]
        while costs and much:
            much = over(costs.pop())
        del context[name][1 + len(costs) :]
    heap = [(-len(owner[key]), nth, owner, key) for nth, (owner, key) in enumerate(_spots(context))]
    heapify(heap)
    while much and heap and -heap[0][0] > 32:
        _, nth, owner, key = heap[0]
        old = owner[key]
        owner[key] = old[: max(16, len(old) * 7 // 10)] + "..."
        much = over(quarters(compact(old)) - quarters(compact(owner[key])))
        heapreplace(heap, (-len(owner[key]), nth, owner, key))
    if much:
        context |= {name: [] for name in DROP_ORDER}
        context["warnings"].append(REMOVED)
        size = quarters(compact(context)) - len(str(state["usedTokens"]))
        over()
    return context


#: Contexts of one batch of a task: each has some 150 records at most.
AT_ONCE = 64


def fit_budgets(contexts: DataFrame) -> DataFrame:
    """contexts: query_id, budget, context (JSON with all lists of DROP_ORDER and warnings). Fits each as fit_budget does:
    query_id, budget, used, truncated, context (JSON)."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, AT_ONCE):
                ids, budgets, texts = (batch.column(c).slice(lo, AT_ONCE) for c in ("query_id", "budget", "context"))
                done = [fit_budget(json.loads(t), b) for t, b in zip(texts.to_pylist(), budgets.to_pylist())]
                used, cut = ([d["budget"][k] for d in done] for k in ("usedTokens", "truncated"))
                yield pa.RecordBatch.from_arrays([ids, budgets, pa.array(used, pa.int64()), pa.array(cut, pa.bool_()), pa.array([compact(d) for d in done], pa.string())], ["query_id", "budget", "used", "truncated", "context"])

    slim = contexts.where("context is not null").select(F.col("query_id").cast("long"), F.col("budget").cast("long"), "context")
    return slim.mapInArrow(run, "query_id long, budget long, used long, truncated boolean, context string")


def assembled(tasks: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """tasks: query_id, query; lists: by name of DROP_ORDER, rows (query_id, place, record struct). query_id, context (JSON).

    Lists are bounded by the limits above, so a context is one row of bounded size.
    """
    out = tasks.select("query_id", "query")
    for name, rows in lists.items():
        one = rows.groupBy(F.col("query_id").alias("_q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "record"))), lambda x: x["record"]).alias(name))
        out = out.join(one, F.col("query_id") == F.col("_q"), "left").drop("_q")
    held = [F.coalesce(F.col(n), F.array()).alias(n) if n in lists else F.array().cast("array<string>").alias(n) for n in ["constraints", "decisions", "lessons", "userMemories", "activeTasks", "relevant", "codeRelations"]]
    whole = F.struct(F.col("query").alias("task"), *held, F.array().cast("array<string>").alias("warnings"))
    return out.select("query_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("context"))


def memory_contexts(chosen: DataFrame, hits: DataFrame, memories: DataFrame, tasks: DataFrame) -> DataFrame:
    """Contexts of many tasks from slots() and memory hits (query_id, id, score, rank): query_id, context (JSON)."""
    record = F.struct("id", "type", "title", "content", "reason", "status", "scope")
    placed = chosen.join(memories, "id").select("query_id", "slot", "place", record.alias("record"))
    lists = {name: placed.where(F.col("slot") == slot).drop("slot") for name, slot in (("constraints", "constraint"), ("decisions", "decision"), ("lessons", "lesson"))}
    found = hits.join(memories.select("id", "title", "content"), "id").select("query_id", F.col("rank").alias("place"), F.struct(F.lit("memory").alias("kind"), "id", "title", "content", "score").alias("record"))
    return assembled(tasks, lists | {"relevant": found})
