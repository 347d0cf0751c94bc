"""Review candidates, records and their states, evidence drift, tasks and scopes."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..store import settled

# How much a candidate's text may hold, and how sure each origin is.
LINES, CHARS, DEFAULT_CONFIDENCE, INFERRED_CONFIDENCE = 8, 1200, 0.9, 0.5
BLANKS = " \t\n\x0b\f\r"
CONFIDENCE = {"added": 0.5, "updated": 0.6, "vcs": 0.55, "summary": 0.75, "risks": 0.7, "completed": 0.7}


def _document(rows: DataFrame, kept: Column, ref: Column, confidence: Column, kind: Column) -> DataFrame:
    content = F.substring(T.trim_all(F.array_join(F.slice(kept, 1, LINES), "\n")), 1, CHARS)
    rows = rows.withColumn("content", content).where((F.col("content") != "") & ~T.likely_secret(F.col("content")))
    rows = rows.withColumn("type", T.infer_type(F.col("content")))
    return rows.select(
        "path", "type", F.concat(F.lit("Review "), F.col("type"), F.lit(" candidate from "), F.col("path")).alias("title"), "content", confidence.alias("confidence"),
        F.array(F.substring_index("path", "/", 1)).alias("scope"), kind.alias("source_kind"), ref.alias("source_ref"), T.candidate_fingerprint(F.col("path"), F.col("type"), F.col("content")).alias("fingerprint"),
    )


def file_candidates(changes: DataFrame) -> DataFrame:
    """changes: path, previous_hash, content. A candidate for each changed knowledge file with durable lines."""
    rows = changes.where(T.is_knowledge_source(F.col("path")))
    trimmed = F.filter(F.transform(T.lines(F.col("content")), T.trim_all), lambda v: v != "")
    confidence = F.when(F.col("previous_hash").isNotNull(), CONFIDENCE["updated"]).otherwise(CONFIDENCE["added"])
    return _document(rows.withColumn("_kept", F.filter(trimmed, T.is_durable)).drop("content"), F.col("_kept"), F.col("path"), confidence, F.lit("file"))


def vcs_candidates(added: DataFrame, kind: str, revision: str | None) -> DataFrame:
    """added: path, line_no, line (added lines of a diff). A candidate for each knowledge file with durable added lines."""
    rows = added.where(T.is_knowledge_source(F.col("path"))).where(T.is_durable(F.col("line")))
    first = Window.partitionBy("path").orderBy("line_no")
    rows = rows.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= LINES)
    rows = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]).alias("_kept"))
    ref = F.concat(F.lit(revision), F.lit(":"), F.col("path")) if revision else F.col("path")
    return _document(rows, F.col("_kept"), ref, F.lit(CONFIDENCE["vcs"]), F.lit(kind))


def task_candidates(tasks: DataFrame, existing: DataFrame) -> DataFrame:
    """tasks: id, goal, summary, risks, completed. At most one candidate a task, none if its reference has one already:
    the summary, else the first risk, else the first durable completed item; a text with a secret gives way to the next."""
    filled = lambda v: T.trim_all(v) != ""
    risk, done = F.get(F.filter("risks", filled), F.lit(0)), F.get(F.filter("completed", T.is_durable), F.lit(0))
    pick = lambda c, t, f: F.struct(F.substring(T.trim_all(c), 1, CHARS).alias("content"), t.alias("type"), F.lit(f).alias("field"), F.lit(CONFIDENCE[f]).alias("confidence"))
    tries = F.array(pick(F.col("summary"), F.lit("task-summary"), "summary"), pick(risk, F.lit("issue"), "risks"), pick(done, T.infer_type(done), "completed"))
    fits = F.filter(tries, lambda x: x["content"].isNotNull() & (x["content"] != "") & ~T.likely_secret(x["content"]))
    rows = tasks.withColumn("_one", F.get(fits, F.lit(0))).where("_one is not null").withColumn("source_ref", F.concat(F.lit("task:"), F.col("id").cast("string")))
    rows = rows.join(existing.select("source_ref"), "source_ref", "left_anti")
    label = F.substring(F.regexp_replace(T.trim_all(F.col("goal")), r"\s+", " "), 1, 80)
    finger = T.sha(F.concat_ws(":", "source_ref", F.col("_one.type"), T.candidate_text(F.col("_one.content"))))
    return rows.select("id", "source_ref", F.col("_one.type").alias("type"), F.concat(F.lit("Review "), F.col("_one.type"), F.lit(" from task: "), label).alias("title"), F.col("_one.content").alias("content"), F.col("_one.field").alias("field"), F.col("_one.confidence").alias("confidence"), finger.alias("fingerprint"))


def superseded(pending: DataFrame, fresh: DataFrame) -> DataFrame:
    """pending: id, source_ref, status; fresh: id, path. Other pending candidates of a fresh one's path become superseded:
    those whose reference is the path or ends in `:path`."""
    ref = F.col("source_ref")
    ends = F.filter(F.transform(F.sequence(F.lit(1), F.length(ref)), lambda i: F.when(F.substr(ref, i, F.lit(1)) == ":", F.substr(ref, i + 1))), lambda x: x.isNotNull())
    paths = F.array_distinct(F.concat(F.array(ref), F.when(F.length(ref) > 0, ends).otherwise(F.array().cast("array<string>"))))
    hits = pending.where("status = 'pending' and source_ref is not null").select(F.col("id").alias("old"), F.explode(paths).alias("p"))
    hits = hits.join(fresh.select(F.col("id").alias("new"), F.col("path").alias("p")), "p").where("old <> new").select(F.col("old").alias("id"), F.lit(True).alias("_hit")).distinct()
    return pending.join(hits, "id", "left").withColumn("status", F.when(F.col("_hit"), "superseded").otherwise(F.col("status"))).drop("_hit")


def decided(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: id, action (accept, reject). Adds outcome: the new status or an error; rejecting twice is no error."""
    met = candidates.join(decisions, "id", "right")
    s, a = F.col("status"), F.col("action")
    outcome = F.when(s.isNull(), "unknown").when((a == "accept") & (s == "pending"), "accepted").when((a == "reject") & s.isin("pending", "rejected"), "rejected").otherwise("not pending")
    return met.select("id", "action", "status", outcome.alias("outcome"))


def memory_errors(rows: DataFrame) -> DataFrame:
    """Adds error: why a memory may not be stored (null if it may)."""
    blank = lambda c: F.coalesce(T.trim_all(F.col(c)), F.lit("")) == ""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")), F.coalesce("reason", F.lit("")))
    return rows.withColumn("error", F.when(blank("title") | blank("content"), "invalid").when(T.likely_secret(text), "sensitive").when(~F.col("confidence").between(0.0, 1.0), "confidence"))


def remembered(memories: DataFrame, fresh: DataFrame) -> DataFrame:
    """memories after storing fresh ones: what they supersede is marked, at their time."""
    ok = memory_errors(fresh).where("error is null").drop("error")
    gone = ok.where("supersedes_id is not null").groupBy(F.col("supersedes_id").alias("_of")).agg(F.max("updated_at").alias("_at"))
    old = memories.join(gone, memories.id == F.col("_of"), "left")
    old = old.withColumn("status", F.when(F.col("_of").isNotNull(), "superseded").otherwise(F.col("status"))).withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_of", "_at")
    return old.unionByName(ok.select(*memories.columns))


#: Excerpts of one source that one automaton holds; a source with more meets them in several.
TOGETHER = 10_000


def _lines_of_excerpts(batches):
    """key, content, wanted (digest, excerpt) -> key, digest, start_line, end_line of the excerpts that stand in the content.

    One automaton of all excerpts passes over the content once.
    """
    import ahocorasick

    for batch in batches:
        out = []
        for key, content, wanted in zip(*(batch.column(c) for c in ("key", "content", "wanted"))):
            body = content.as_py().replace("\r\n", "\n").strip(BLANKS)
            machine, parts = ahocorasick.Automaton(), {}
            for w in wanted.as_py():
                part = w["excerpt"].replace("\r\n", "\n").strip(BLANKS)
                if part and hashlib.sha256(part.encode()).hexdigest() == w["digest"]:
                    parts.setdefault(part, []).append(w["digest"])
                    machine.add_word(part, part)
            if not parts:
                continue
            machine.make_automaton()
            first: dict[str, int] = {}
            for end, part in machine.iter(body):
                if part not in first:
                    first[part] = end - len(part) + 1
                    if len(first) == len(parts):
                        break
            breaks = [x.start() for x in re.finditer("\n", body)] if first else []
            for part, at in first.items():
                line = bisect_left(breaks, at) + 1
                out += [(key.as_py(), d, line, line + part.count("\n")) for d in parts[part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, (pa.string(), pa.string(), pa.int32(), pa.int32()))], ["key", "digest", "start_line", "end_line"])


def located(wanted: DataFrame, sources: DataFrame, together: int = TOGETHER) -> DataFrame:
    """wanted: path, excerpt, excerpt_hash; sources: path, content (path unique). path, excerpt_hash, start_line, end_line of
    every excerpt that stands in its source (and whose hash holds), counted in the trimmed content.

    Equal excerpts of a source are one; they meet its content in groups of about `together`, so the content is copied once a
    group, whatever the number of bindings, and no group grows with it.
    """
    one = wanted.groupBy("path", "excerpt_hash", "excerpt").agg(F.count("*").alias("_n"))
    many = one.groupBy(F.col("path").alias("_path")).agg(F.ceil(F.count("*") / F.lit(together)).alias("_groups"))
    dealt = one.join(many, F.col("path") == F.col("_path")).withColumn("_group", F.pmod(F.xxhash64("excerpt_hash", "excerpt"), F.col("_groups")))
    groups = dealt.groupBy("path", "_group").agg(F.collect_list(F.struct(F.col("excerpt_hash").alias("digest"), "excerpt")).alias("wanted"))
    met = groups.join(sources.select("path", "content"), "path").select(F.col("path").alias("key"), "content", "wanted")
    found = met.mapInArrow(_lines_of_excerpts, "key string, digest string, start_line int, end_line int")
    # two forms of one excerpt (line ends, blanks around it) have one hash and one place
    return found.groupBy(F.col("key").alias("path"), F.col("digest").alias("excerpt_hash")).agg(F.min("start_line").alias("start_line"), F.min("end_line").alias("end_line"))


def drift(memories: DataFrame, bindings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stale memory ids, and refreshed bindings (binding_id, memory_id, source_hash, start_line, end_line).

    An active memory's file binding fails if its source is unset or gone or its hash differs (an unknown hash does not).
    A failing binding whose excerpt still stands in the source is refreshed; any other makes its memory stale.
    """
    b = bindings.where("source_kind = 'file'").select(F.col("id").alias("binding_id"), "memory_id", "source_path", F.col("source_hash").alias("bound_hash"), "excerpt", "excerpt_hash")
    m = memories.where("status = 'active'").select(F.col("id").alias("memory_id"))
    s = sources.select(F.col("path").alias("s_path"), "content_hash")
    rows = b.join(m, "memory_id", "left_semi").join(s, F.col("source_path") == F.col("s_path"), "left")
    rows = settled(rows.where("source_path is null or s_path is null or bound_hash <> content_hash"))
    known = F.col("s_path").isNotNull() & (F.coalesce("content_hash", F.lit("")) != "") & (F.coalesce("excerpt", F.lit("")) != "") & (F.coalesce("excerpt_hash", F.lit("")) != "")
    at = located(rows.where(known).select(F.col("s_path").alias("path"), "excerpt", "excerpt_hash"), sources)
    at = at.select(F.col("path").alias("_path"), F.col("excerpt_hash").alias("_hash"), "start_line", "end_line")
    rows = rows.withColumn("_known", known).join(at, F.col("_known") & (F.col("s_path") == F.col("_path")) & (F.col("excerpt_hash") == F.col("_hash")), "left")
    stale = rows.where("start_line is null").select(F.col("memory_id").alias("id")).distinct()
    fresh = rows.where("start_line is not null").select("binding_id", "memory_id", F.col("content_hash").alias("source_hash"), "start_line", "end_line")
    return stale, fresh


def scope_error(level: Column, project_id: Column, ref: Column) -> Column:
    """Why a user memory's scope is not valid (null if it is)."""
    p, r = F.coalesce(project_id, F.lit("")) != "", F.coalesce(ref, F.lit("")) != ""
    absolute = ref.startswith("/") | ref.rlike(r"^[A-Za-z]:[\\/]")
    return (
        F.when((level == "user") & (p | r), "user scope takes no project and no reference")
        .when((level == "workspace") & (~r | ~F.coalesce(absolute, F.lit(False)) | p), "workspace scope takes an absolute reference and no project")
        .when((level == "project") & (~p | r), "project scope takes a project and no reference")
        .when(level.isin("module", "task") & (~p | ~r), "module and task scopes take both")
    )


def applicable(memories: DataFrame, projects: DataFrame, newest: int = 500, limit: int = 100) -> DataFrame:
    """projects: project, root_path, task. The user memories that hold for each: project, id, place.

    Of the newest active ones: user scope always, workspace scope around the root, project scope of the same project,
    module and task scope if the task's text names their reference.
    """
    base = memories.where("status = 'active'").orderBy(F.desc("updated_at"), "id").limit(newest)  # `newest` rows
    level, ref = F.col("scope_level"), F.col("scope_ref")
    same = F.coalesce(F.col("project_id") == F.col("project"), F.lit(False))
    holds = (level == "user") | ((level == "workspace") & T.within_root(ref, F.col("root_path"))) | (same & (level == "project")) | (same & level.isin("module", "task") & F.contains(F.lower("task"), F.lower(ref)))
    met = projects.join(F.broadcast(base), F.coalesce(holds, F.lit(False)))  # bound: `newest` rows; no key exists for scopes
    order = Window.partitionBy("project").orderBy(F.desc("updated_at"), "id")
    return met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).select("project", "id", "place")


def task_transition(status: Column, action: Column) -> Column:
    """The status after an action, or an error: complete and cancel are idempotent, else they need a task in progress."""
    done = F.when(action == "complete", "completed").when(action == "cancel", "cancelled")
    return F.when(status.isNull(), F.when(action == "start", "in_progress").otherwise("error: unknown")).when(action == "checkpoint", status).when(status == done, status).when((status == "in_progress") & done.isNotNull(), done).otherwise("error: not in progress")


def rule_transition(status: Column, action: Column, user_level: Column) -> Column:
    """Whether a stored rule may be versioned, reactivated or deleted: the new status or null."""
    return (
        F.when((action == "version") & (status == "active"), "superseded")
        .when((action == "reactivate") & (status == "deleted"), "active")
        .when((action == "delete") & user_level & (status == "active"), "deleted")
        .when((action == "delete") & ~user_level & status.isin("stale", "conflicted"), "deleted")
    )


def archived(projects: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Archives projects; a project archived before keeps its first time."""
    hit = ids.select(F.col("id").alias("_h")).distinct()
    return projects.join(hit, projects.id == F.col("_h"), "left").withColumn("archived_at", F.when(F.col("_h").isNotNull(), F.coalesce("archived_at", at)).otherwise(F.col("archived_at"))).drop("_h")


def listed_projects(projects: DataFrame, archived_too: bool = False) -> DataFrame:
    return (projects if archived_too else projects.where("archived_at is null")).orderBy(F.desc("last_opened_at"), "id")
