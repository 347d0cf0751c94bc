"""The public surface: projects that are indexed, searched, remembered and reviewed, over versioned tables.

Every method builds DataFrames from the operators; the driver holds single records only. Times are UTC timestamps.
"""

from __future__ import annotations

import hashlib
import json
import os
import threading
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions import text as T
from .operators import context, graph, health, index, ingest, lifecycle, search
from .sources import code, files, tree, vcs
from .store import Store
from .streaming import debounce

PROJECTS = "id string, name string, root_path string, created_at timestamp, last_opened_at timestamp, archived_at timestamp"
TABLES = {"sources": S.SOURCES, "chunks": S.CHUNKS, "symbols": S.SYMBOLS, "relations": S.RELATIONS, "memories": S.MEMORIES, "bindings": S.BINDINGS, "candidates": S.CANDIDATES, "tasks": S.TASKS, "runs": S.RUNS, "vcs_state": S.VCS_STATE}
#: The tables whose rows are items of the search index.
KIND_TABLES = {"chunk": "chunks", "memory": "memories", "symbol": "symbols"}
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
HEADER = "salt binary, n int, r int, p int"
#: Cost, block size and parallelism of the key derivation.
SCRYPT = (16384, 8, 1)
EMPTY_CHECKPOINT = {"summary": None, "completed": [], "next": [], "changedFiles": [], "verification": [], "blockers": [], "risks": []}


class Cancelled(RuntimeError):
    """Work that was stopped on request and can be taken up again."""


class NotAllowed(ValueError):
    """A request that the rules of a record's life do not allow."""


#: Index runs of this process, by workspace and project.
_RUNNING: set[tuple[str, str]] = set()
_GUARD = threading.Lock()


def _now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def _id(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4()}"


class Workspace:
    def __init__(self, spark: SparkSession, home: str, index_parts: int = index.PARTS):
        """index_parts: parts of the search index, a power of two (more for projects whose parts outgrow a task)."""
        self.spark, self.home, self.parts = spark, home.rstrip("/"), index_parts
        self.registry = Store(spark, f"{self.home}/registry")

    # --- tables ---

    def _store(self, project: str) -> Store:
        return Store(self.spark, f"{self.home}/projects/{project}")

    def table(self, project: str, name: str) -> DataFrame:
        return self._store(project).read(name, TABLES[name])

    def _row(self, df: DataFrame, key: str, what: str) -> dict:
        got = df.where(F.col("id") == key).limit(1).collect()
        if not got:
            raise KeyError(f"unknown {what}: {key}")
        return got[0].asDict(recursive=True)

    def _put(self, store: Store, name: str, schema: str, row: dict) -> None:
        """Upserts one record by id."""
        fresh = self.spark.createDataFrame([tuple(row.get(f.name) for f in S.struct(schema).fields)], schema)
        store.write(name, store.read(name, schema).join(fresh.select("id"), "id", "left_anti").select(*fresh.columns).unionByName(fresh))

    # --- projects ---

    def projects(self, archived: bool = False) -> DataFrame:
        return lifecycle.listed_projects(self.registry.read("projects", PROJECTS), archived)

    def project_open(self, root: str, name: str | None = None) -> str:
        root = root.rstrip("/")
        have = self.registry.read("projects", PROJECTS).where(F.col("root_path") == root).limit(1).collect()
        row = have[0].asDict() if have else {"id": _id("prj"), "root_path": root, "name": name or root.rsplit("/", 1)[-1], "created_at": _now(), "archived_at": None}
        if row["archived_at"] is not None:
            raise NotAllowed("the project is archived")
        self._put(self.registry, "projects", PROJECTS, row | {"last_opened_at": _now()})
        return row["id"]

    def _project(self, project: str) -> dict:
        return self._row(self.registry.read("projects", PROJECTS), project, "project")

    def project_update(self, project: str, name: str) -> None:
        self._put(self.registry, "projects", PROJECTS, self._project(project) | {"name": name})

    def project_archive(self, project: str) -> None:
        row = self._project(project)
        self._put(self.registry, "projects", PROJECTS, row | {"archived_at": row["archived_at"] or _now()})

    def project_unarchive(self, project: str) -> None:
        self._put(self.registry, "projects", PROJECTS, self._project(project) | {"archived_at": None})

    def project_relocate(self, project: str, root: str) -> None:
        root = root.rstrip("/")
        if not self.registry.read("projects", PROJECTS).where((F.col("root_path") == root) & (F.col("id") != project)).isEmpty():
            raise NotAllowed("another project has this path")
        self._put(self.registry, "projects", PROJECTS, self._project(project) | {"root_path": root})

    def project_delete(self, project: str, confirm: str, purge: bool = False) -> None:
        row = self._project(project)
        if row["archived_at"] is None or confirm != project:
            raise NotAllowed("only an archived project goes, and its id must be given again")
        if purge:
            left = health.guard_counts(*(self.table(project, t) for t in ("memories", "tasks", "candidates"))).first().asDict()
            if any(left.values()):
                raise NotAllowed(f"not empty: {left}")
            self._store(project).drop()
        self.registry.write("projects", self.registry.read("projects", PROJECTS).where(F.col("id") != project))

    # --- indexing ---

    def project_index(self, project: str, snapshot: dict | None = None, run: str | None = None) -> dict:
        """One incremental run: scan, difference, derive what changed, drop what is gone, candidates, drift.

        One run of a project at a time: a second one is refused while the first goes on. run: the id it has in the run log.
        """
        key = (self.home, project)
        with _GUARD:
            if key in _RUNNING:
                raise NotAllowed("an index run of this project is going on")
            _RUNNING.add(key)
        try:
            return self._index_run(project, snapshot, run)
        finally:
            with _GUARD:
                _RUNNING.discard(key)

    def _index_run(self, project: str, snapshot: dict | None, run: str | None) -> dict:
        root, store, started = self._project(project)["root_path"], self._store(project), _now()
        old = self.table(project, "sources")
        scanned = files.scan(self.spark, root).cache()
        counts = ingest.run_counts(scanned, old).first().asDict()
        fresh = scanned.where("skip_reason is null").select("path", "content", "content_hash", "size_bytes", "kind")
        diff = ingest.snapshot_diff(old, fresh).cache()
        touched, changed = diff.where("change <> 'unchanged'").cache(), diff.where("change in ('added', 'updated')")
        new = fresh.join(changed.select("path"), "path", "left_semi").cache()
        chunks = ingest.chunks(new).withColumn("id", T.content_id("chk_", F.col("path"), F.col("start_line").cast("string"), F.col("content")))
        symbols, relations = code.extract(new)
        some = not touched.isEmpty()  # without changes no table gets a new version
        for name, rows in (("chunks", chunks), ("symbols", symbols), ("relations", relations)) if some else ():
            have = self.table(project, name)
            store.write(name, ingest.replaced(have, touched, rows.select(*have.columns)))
        snapshot = snapshot or vcs.snapshot(root)
        state = self.spark.createDataFrame([(k, v, started) for k, v in vcs.state(snapshot).items()], S.VCS_STATE)
        store.write("vcs_state", ingest.upsert_latest(self.table(project, "vcs_state"), state, "key", [F.col("captured_at"), F.col("value")]).select("key", "value", "captured_at"))
        by_vcs = vcs.added_lines(self.spark.createDataFrame([("", snapshot["diff"])], "diff_id string, diff string"))
        file_changes = new.join(changed.select("path", F.col("old_hash").alias("previous_hash")), "path").join(by_vcs.select("path").distinct(), "path", "left_anti")
        made = lifecycle.file_candidates(file_changes).unionByName(lifecycle.vcs_candidates(by_vcs, snapshot["kind"] or "git", snapshot["revision"]))
        generated = self._add_candidates(project, made)
        if some:
            store.write("sources", fresh)
        stale, refreshed = lifecycle.drift(self.table(project, "memories"), self.table(project, "bindings"), self.table(project, "sources"))
        gone = [r.id for r in stale.collect()]  # ids of single memories
        moved = refreshed.withColumnsRenamed({"binding_id": "id", "source_hash": "_hash", "start_line": "_start", "end_line": "_end"}).drop("memory_id")
        have = self.table(project, "bindings")
        store.write("bindings", have.join(moved, "id", "left").withColumns({"source_hash": F.coalesce("_hash", "source_hash"), "start_line": F.coalesce("_start", "start_line"), "end_line": F.coalesce("_end", "end_line")}).select(*have.columns))
        if gone:
            have = self.table(project, "memories")
            lost = F.col("id").isin(gone)
            store.write("memories", have.withColumn("status", F.when(lost, "stale").otherwise(F.col("status"))).withColumn("updated_at", F.when(lost, F.lit(_now())).otherwise(F.col("updated_at"))))
        self._put(store, "runs", S.RUNS, {"id": run or _id("idx"), "started_at": started, "status": "completed", "errors": []} | counts)
        for df in (scanned, diff, touched, new):
            df.unpersist()
        return counts | {"candidates": generated, "stale": gone}

    def _add_candidates(self, project: str, made: DataFrame) -> list[str]:
        store, have = self._store(project), self.table(project, "candidates")
        rows = made.withColumns({"id": T.content_id("cand_", F.col("fingerprint")), "status": F.lit("pending"), "created_at": F.lit(_now())})
        for c in ("scope", "path", "source_kind"):
            if c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(S.struct(S.CANDIDATES)[c].dataType))
        fresh = ingest.insert_ignore(have, rows.select(*have.columns), "fingerprint", [F.col("source_ref"), F.col("id")]).cache()
        ids = [r.id for r in fresh.select("id").collect()]
        if ids:
            store.write("candidates", lifecycle.superseded(have, fresh.where("path is not null").select("id", "path")).select(*have.columns).unionByName(fresh))
        fresh.unpersist()
        return ids

    def project_health(self, project: str) -> dict:
        t = {n: self.table(project, n) for n in TABLES}
        counts = {r.metric: r.n for r in health.counts({n: t[n] for n in ("sources", "chunks", "symbols", "relations")}).collect()}
        statuses = {n: {r.status: r.n for r in health.status_counts(t[n], n).collect()} for n in ("memories", "candidates", "tasks")}
        last = health.latest_run(t["runs"]).collect()
        return counts | statuses | {"lastIndexRun": last[0].asDict(recursive=True) if last else None}

    def project_doctor(self, project: str, repair: bool = False) -> list[str]:
        """What is wrong: indexes that differ from their tables, references that lead nowhere, indexed files that are gone,
        unsafe paths. An index that knows itself to be behind its tables is not compared: the next search updates it.
        repair: derives a search index that differs anew and says so."""
        t, items = {n: self.table(project, n) for n in TABLES}, self._index(project)["items"]
        self.spark.dataSource.register(tree.TreeSource)
        files_now = self.spark.read.format("tree").option("root", self._project(project)["root_path"]).load().select("path")
        of = lambda k: items.where(F.col("kind") == k).select("id")
        store = self._store(project)
        marker = store.read("index_marker", index.MARKER).first()
        indexed = marker is not None and not marker.open and marker.versions == {n: v[-1] for n in KIND_TABLES.values() if (v := store.versions(n))}
        pairs = {f"{n} in the search index": (t[n].select("id"), of(k)) for k, n in KIND_TABLES.items()} if indexed else {}
        pairs |= {"chunks of sources": (t["sources"].select("path"), t["chunks"].select("path")), "files of sources": (t["sources"].select("path"), files_now.join(t["sources"], "path", "left_semi"))}
        references = {
            "memories of bindings": (t["memories"].select("id"), t["bindings"].select("memory_id")), "sources of bindings": (t["sources"].select("path"), t["bindings"].select("source_path")),
            "symbols of relations": (t["symbols"].select("id"), t["relations"].select("from_id")), "memories of memories": (t["memories"].select("id"), t["memories"].select("supersedes_id")),
            "sources of symbols": (t["sources"].select("path"), t["symbols"].select("path")),
        }
        bad = []
        for r in health.doctor(pairs, references).orderBy("name").collect():  # a row a name
            bad += [f"{r.name}: {n} {word}" for n, word in ((r.missing, "missing"), (r.orphaned, "orphaned"), (r.dangling, "dangling")) if n]
        if repair and any("search index" in x for x in bad):
            self.search_rebuild(project)
            bad.append("repaired: the search index is derived anew")
        return bad + [f"unsafe path: {r.path}" for r in health.unsafe_paths(t["sources"]).limit(100).collect()]

    def project_portrait(self, project: str) -> DataFrame:
        return health.portrait(*(self.table(project, t) for t in ("sources", "memories", "tasks", "candidates")))

    def project_export(self, project: str, directory: str) -> DataFrame:
        order = {"memories": ["created_at", "id"], "candidates": ["created_at", "id"], "tasks": ["created_at", "id"], "symbols": ["path", "start_line", "id"], "relations": ["path", "start_line", "id"]}
        return ingest.export_jsonl({n: (self.table(project, n), [F.col(c) for c in o]) for n, o in order.items()}, directory)

    def project_backup(self, project: str, directory: str) -> None:
        self._store(project).copy_to(directory, list(TABLES))

    def project_restore(self, directory: str, root: str) -> str:
        """A backup as a new project."""
        project = self.project_open(root)
        if not self.table(project, "sources").isEmpty():
            raise NotAllowed("the project is not new")
        Store(self.spark, directory).copy_to(f"{self.home}/projects/{project}", list(TABLES))
        return project

    def project_backup_encrypted(self, project: str, directory: str, password: str) -> None:
        """Like project_backup, each record sealed with AES-256-GCM; the key comes from the password by scrypt.

        The header (salt, parameters, table) is authenticated with every record. The key travels as data, not in plans.
        """
        salt = os.urandom(16)
        target = Store(self.spark, directory)
        if target.versions("header"):
            raise FileExistsError(directory)
        target.write("header", self.spark.createDataFrame([(salt, *SCRYPT)], HEADER))
        key = self._key(password, salt)
        for name in TABLES:
            rows = self.table(project, name)
            sealed = rows.select(F.to_json(F.struct(*rows.columns), EXACT).alias("row")).join(F.broadcast(key), F.lit(True))  # one row
            target.write(name, sealed.select(F.aes_encrypt("row", "key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(self._aad(salt, name))).alias("sealed")))

    def project_restore_encrypted(self, directory: str, root: str, password: str) -> str:
        """A sealed backup as a new project. A wrong password or a changed record raises, and nothing is left behind."""
        source = Store(self.spark, directory)
        head = source.read("header", HEADER).first()
        project = self.project_open(root)
        if not self.table(project, "sources").isEmpty():
            raise NotAllowed("the project is not new")
        salt = bytes(head.salt)
        key, store = self._key(password, salt, (head.n, head.r, head.p)), self._store(project)
        try:
            for name, schema in TABLES.items():
                row = F.aes_decrypt("sealed", "key", F.lit("GCM"), F.lit("DEFAULT"), F.lit(self._aad(salt, name))).cast("string")
                opened = source.read(name, "sealed binary").join(F.broadcast(key), F.lit(True)).select(F.from_json(row, schema, EXACT).alias("r")).select("r.*")  # one row
                store.write(name, opened)
        except Exception:
            store.drop()
            self.registry.write("projects", self.registry.read("projects", PROJECTS).where(F.col("id") != project))
            raise
        return project

    def _key(self, password: str, salt: bytes, scrypt: tuple[int, int, int] | None = None) -> DataFrame:
        n, r, p = scrypt or SCRYPT
        return self.spark.createDataFrame([(hashlib.scrypt(password.encode(), salt=salt, n=n, r=r, p=p, dklen=32),)], "key binary")

    @staticmethod
    def _aad(salt: bytes, name: str) -> bytes:
        return f"marlspike-backup-1:{salt.hex()}:{name}".encode()

    # --- watching ---

    def _watched(self, project: str) -> str:
        """The folder in which a watcher keeps its listings and its progress (of a mounted tree, like the project's)."""
        return f"{self.home.removeprefix('file://')}/projects/{project}/watch"

    def watch_start(self, project: str, quiet_ms: int = debounce.DEFAULT_MS) -> str:
        """A stream of the tree's changes, each batch of which is one index run.

        The run log holds a run by its batch: a batch that is run again after a failure finds its run there or does it now,
        so every change is indexed once, over restarts too.
        """
        root = self._project(project)["root_path"]
        if any(w["project"] == project for w in self.watch_list()):
            raise NotAllowed("the project is watched already")
        quiet = max(debounce.LEAST_MS, min(debounce.MOST_MS, quiet_ms))

        def run(changes: DataFrame, batch: int) -> None:
            key = f"idx_watch_{project}_{batch}"
            if not changes.isEmpty() and self.table(project, "runs").where(F.col("id") == key).isEmpty():
                self.project_index(project, run=key)

        self.spark.dataSource.register(tree.TreeSource)
        at, rules = self._watched(project), files.IgnoreRules.for_root(root)
        stream = self.spark.readStream.format("tree").options(root=root, rules=json.dumps(rules.lines), state=f"{at}/listings", quiet=str(quiet)).load()
        q = stream.writeStream.queryName(f"watch {project}").option("checkpointLocation", f"{at}/progress").trigger(processingTime=f"{quiet} milliseconds").foreachBatch(run).start()
        return str(q.id)

    def watch_list(self) -> list[dict]:
        return [{"project": q.name.removeprefix("watch "), "id": str(q.id), "status": q.status, "batches": (q.lastProgress or {}).get("batchId")} for q in self.spark.streams.active if (q.name or "").startswith("watch ")]

    def watch_flush(self, project: str) -> None:
        """Waits until what has changed by now is indexed; an error of the watcher surfaces here."""
        for q in self.spark.streams.active:
            if q.name == f"watch {project}":
                tree.ask_flush(f"{self._watched(project)}/listings")
                while os.path.exists(f"{self._watched(project)}/listings/flush"):  # until the watcher has looked
                    q.processAllAvailable()
                q.processAllAvailable()

    def watch_stop(self, project: str) -> None:
        for q in self.spark.streams.active:
            if q.name == f"watch {project}":
                q.stop()

    def ignore_preview(self, project: str, rules: str) -> dict:
        return files.ignore_preview(self.table(project, "sources"), files.IgnoreRules.for_root(self._project(project)["root_path"], rules)).first().asDict()

    # --- search and graph ---

    def _kinds(self, project: str) -> dict[str, DataFrame]:
        return {k: self.table(project, n) for k, n in KIND_TABLES.items()}

    def _index(self, project: str) -> dict[str, DataFrame]:
        store = self._store(project)
        return {t: store.read_parts(f"index_{t}", schema) for t, schema in index.SCHEMAS.items()}

    def search_update(self, project: str) -> int:
        """Brings the stored index up to date; how many items were derived anew.

        Nothing is read if no table has a new version. Otherwise digests of the tables that have one are compared, and the
        parts of items that differ are overwritten, the others not. The marker names the parts before they are written
        and the versions afterwards: parts that an interruption left open are derived from their items in full.
        """
        store, kinds = self._store(project), self._kinds(project)
        now = {n: v[-1] for n in KIND_TABLES.values() if (v := store.versions(n))}
        held = store.read("index_marker", index.MARKER).first()
        if held is None or held.parts != self.parts:
            return self.search_rebuild(project) if now else 0
        opened = list(held.open)
        if held.versions == now and not opened:
            return 0
        new = {k: kinds[k] for k, n in KIND_TABLES.items() if opened or held.versions.get(n) != now.get(n)}
        have = self._index(project)
        fresh, gone = index.difference(have["items"], new, self.parts)
        if opened:
            mine = index.digests(kinds, self.parts).where(F.col("part").isin(opened)).select("kind", "id", "part")
            fresh = fresh.unionByName(mine).distinct()
            have = {t: df.where(~F.col("part").isin(opened)) for t, df in have.items()}
        fresh, gone = fresh.cache(), gone.cache()
        touched = sorted({r.part for df in (fresh, gone) for r in df.select("part").distinct().collect()} | set(opened))  # at most as many as there are parts
        n = fresh.count()
        if touched:
            self._mark_index(store, held.versions, held.fine, touched)
            self._write_parts(store, index.updated(have, kinds, fresh, gone, touched, self.parts), held.fine, touched)
        self._mark_index(store, now, held.fine, [])
        fresh.unpersist()
        gone.unpersist()
        items = store.read_parts("index_items", index.SCHEMAS["items"]).count()
        if index.fineness(items, self.parts) > 4 * held.fine:  # blocks have grown too coarse
            return self.search_rebuild(project)
        return n

    def _mark_index(self, store: Store, versions: dict, fine: int, opened: list[int]) -> None:
        store.write("index_marker", self.spark.createDataFrame([(versions, fine, self.parts, opened)], index.MARKER))

    def _write_parts(self, store: Store, made: dict[str, DataFrame], fine: int, parts: list[int]) -> None:
        """The tables of some parts; items go last, as they say what the index holds."""
        for t in ("grams", "postings"):
            store.overwrite_parts(f"index_{t}", index.arranged(made[t]), "part", parts)
        post = store.read_parts("index_postings", index.SCHEMAS["postings"]).where(F.col("part").isin(parts))
        store.overwrite_parts("index_blocks", index.arranged(index.blocked(post, fine, self.parts)), "part", parts)
        store.overwrite_parts("index_items", index.arranged(made["items"]), "part", parts)

    def search_rebuild(self, project: str, cancelled: Callable[[], bool] = lambda: False, at_once: int = 16) -> int:
        """Derives the stored index anew from all items, `at_once` parts at a time; how many items it holds.

        Asks `cancelled` between the steps and raises Cancelled if so; the marker says which parts are left, and the next
        update or rebuild derives them.
        """
        store, kinds = self._store(project), self._kinds(project)
        now = {n: v[-1] for n in KIND_TABLES.values() if (v := store.versions(n))}
        fine = index.fineness(sum(df.count() for df in kinds.values()), self.parts)
        for t in index.SCHEMAS:
            store.remove(f"index_{t}")
        for lo in range(0, self.parts, at_once):
            left, here = list(range(lo, self.parts)), list(range(lo, min(lo + at_once, self.parts)))
            self._mark_index(store, now, fine, left)
            if cancelled():
                raise Cancelled(f"{len(left)} parts of the index are left")
            some = {k: df.where(index.part_of(F.col("id"), self.parts).isin(here)) for k, df in kinds.items()}
            self._write_parts(store, index.entries(some, self.parts), fine, here)
        self._mark_index(store, now, fine, [])
        return store.read_parts("index_items", index.SCHEMAS["items"]).count()

    def project_search(self, project: str, query: str, limit: int = 20) -> DataFrame:
        """Over the stored index, which is brought up to date first: a look at the tables' versions if nothing has changed."""
        self.search_update(project)
        t, stored = {n: self.table(project, n) for n in ("chunks", "memories", "symbols", "relations")}, self._index(project)
        q = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return search.hybrid(t["chunks"], t["memories"], t["symbols"], t["relations"], q, max(1, min(limit, 100)), stored).drop("query_id")

    def _resolved(self, project: str) -> DataFrame:
        r = self.table(project, "relations")
        found = graph.resolved(r, self.table(project, "symbols"))
        imports = graph.import_paths(r.withColumnRenamed("id", "key"), self.table(project, "sources"))
        return found.join(imports, found.id == imports.key, "left").withColumn("target_path", F.coalesce("target_path", "import_path")).drop("key", "import_path")

    def graph_overview(self, project: str, limit: int = 80, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        return graph.overview(self.table(project, "sources"), self.table(project, "symbols"), graph.file_edges(graph.of_types(self._resolved(project), types)), limit)

    def graph_totals(self, project: str, limit: int = 80, types: list[str] | None = None) -> dict:
        """How much an overview stands for: nodes, edges, whether it leaves some out, relations by type."""
        edges = graph.file_edges(graph.of_types(self._resolved(project), types))
        row = graph.overview_report(self.table(project, "sources"), self.table(project, "relations"), edges, limit).first().asDict()
        return row | {"types": {t: (row["types"] or {}).get(t, 0) for t in S.RELATION_TYPES}}

    def graph_neighbours(self, project: str, node: str, depth: int = 1, limit: int = 100, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        found = self._resolved(project)
        nodes = graph.neighbours(found, self.table(project, "symbols"), node, depth, limit, types)
        return nodes, graph.induced_edges(found, nodes, types=types)

    def graph_file(self, project: str, path: str) -> DataFrame:
        return graph.file_details(self.table(project, "symbols"), self.table(project, "relations"), path)

    def graph_search(self, project: str, query: str, limit: int = 20) -> DataFrame:
        return graph.search(self.table(project, "symbols"), self.table(project, "sources"), query, limit)

    # --- memories and candidates ---

    def memory_remember(self, project: str, type: str, title: str, content: str, reason: str | None = None, status: str = "active", confidence: float | None = None, scope: list[str] = (), source_kind: str = "user", source_ref: str | None = None, supersedes_id: str | None = None) -> str:
        if type not in S.MEMORY_TYPES or status not in S.MEMORY_STATUSES:
            raise NotAllowed(f"no such type or status: {type}, {status}")
        sure = confidence if confidence is not None else lifecycle.INFERRED_CONFIDENCE if source_kind == "inferred" else lifecycle.DEFAULT_CONFIDENCE
        row = {"id": _id("mem"), "type": type, "title": title.strip(), "content": content.strip(), "reason": reason, "status": status, "confidence": sure, "scope": list(scope), "source_kind": source_kind, "source_ref": source_ref, "supersedes_id": supersedes_id, "created_at": _now(), "updated_at": _now()}
        fresh = self.spark.createDataFrame([tuple(row[f.name] for f in S.struct(S.MEMORIES).fields)], S.MEMORIES)
        error = lifecycle.memory_errors(fresh).first()["error"]
        if error:
            raise NotAllowed(error)
        store = self._store(project)
        store.write("memories", lifecycle.remembered(self.table(project, "memories"), fresh))
        bind = {"id": _id("msrc"), "memory_id": row["id"], "source_kind": source_kind}
        if source_kind == "file" and source_ref:
            ref = self.spark.range(1).select(T.source_ref(F.lit(source_ref)).alias("r")).first().r
            at = self.table(project, "sources").where(F.col("path") == ref.path)
            excerpt = T.excerpt(F.col("content"), F.lit(ref.start_line), F.lit(ref.end_line)) if ref.start_line else F.lit(None).cast("struct<content:string,start_line:int,end_line:int>")
            got = at.select("path", "content_hash", excerpt.alias("e")).limit(1).collect()
            e = got[0].e if got else None
            bind |= {"source_path": got[0].path if got else None, "source_hash": got[0].content_hash if got else None, "start_line": e.start_line if e else ref.start_line, "end_line": e.end_line if e else ref.end_line, "excerpt": e.content if e else None}
            if e:
                bind["excerpt_hash"] = self.spark.range(1).select(T.sha(F.lit(e.content))).first()[0]
        self._put(store, "bindings", S.BINDINGS, bind)
        return row["id"]

    def memory_list(self, project: str, status: str = "active", limit: int = 50) -> DataFrame:
        return ingest.page(self.table(project, "memories"), F.col("status") == status, [F.desc("updated_at"), F.col("id")], limit)

    def memory_update_status(self, project: str, memory: str, status: str) -> None:
        if status not in S.MEMORY_STATUSES:
            raise NotAllowed(status)
        row = self._row(self.table(project, "memories"), memory, "memory")
        self._put(self._store(project), "memories", S.MEMORIES, row | {"status": status, "updated_at": _now()})

    def memory_candidates(self, project: str, status: str = "pending", limit: int = 50) -> DataFrame:
        return ingest.page(self.table(project, "candidates"), F.col("status") == status, [F.desc("created_at"), F.col("id")], limit)

    def memory_candidate_accept(self, project: str, candidate: str) -> str:
        row = self._row(self.table(project, "candidates"), candidate, "candidate")
        if row["status"] != "pending":
            raise NotAllowed("the candidate is not pending")
        made = self.memory_remember(project, row["type"], row["title"], row["content"], confidence=row["confidence"], scope=row["scope"] or [], source_kind=row["source_kind"] or "tool", source_ref=row["source_ref"])
        self._put(self._store(project), "candidates", S.CANDIDATES, row | {"status": "accepted"})
        return made

    def memory_candidate_reject(self, project: str, candidate: str) -> None:
        row = self._row(self.table(project, "candidates"), candidate, "candidate")
        if row["status"] not in ("pending", "rejected"):
            raise NotAllowed("the candidate is not pending")
        self._put(self._store(project), "candidates", S.CANDIDATES, row | {"status": "rejected"})

    # --- user memories ---

    def user_memory_remember(self, type: str, title: str, content: str, scope_level: str = "user", project_id: str | None = None, scope_ref: str | None = None, reason: str | None = None, confidence: float = lifecycle.DEFAULT_CONFIDENCE, source_kind: str = "user", supersedes_id: str | None = None) -> str:
        row = {"id": _id("umem"), "type": type, "title": title.strip(), "content": content.strip(), "reason": reason, "status": "active", "confidence": confidence, "scope_level": scope_level, "project_id": project_id, "scope_ref": scope_ref, "source_kind": source_kind, "supersedes_id": supersedes_id, "created_at": _now(), "updated_at": _now()}
        fresh = self.spark.createDataFrame([tuple(row[f.name] for f in S.struct(S.USER_MEMORIES).fields)], S.USER_MEMORIES)
        found = lifecycle.memory_errors(fresh).select("error", lifecycle.scope_error(F.col("scope_level"), F.col("project_id"), F.col("scope_ref")).alias("scope")).first()
        if scope_level not in S.SCOPE_LEVELS or found.error or found.scope:
            raise NotAllowed(found.error or found.scope or scope_level)
        self.registry.write("user_memories", lifecycle.remembered(self.registry.read("user_memories", S.USER_MEMORIES), fresh))
        return row["id"]

    def user_memory_list(self, status: str = "active", limit: int = 50) -> DataFrame:
        return ingest.page(self.registry.read("user_memories", S.USER_MEMORIES), F.col("status") == status, [F.desc("updated_at"), F.col("id")], limit)

    def user_memory_update_status(self, memory: str, status: str) -> None:
        row = self._row(self.registry.read("user_memories", S.USER_MEMORIES), memory, "memory")
        self._put(self.registry, "user_memories", S.USER_MEMORIES, row | {"status": status, "updated_at": _now()})

    # --- tasks ---

    def task_start(self, project: str, goal: str) -> str:
        row = {"id": _id("task"), "goal": goal, "status": "in_progress", "checkpoint": dict(EMPTY_CHECKPOINT), "created_at": _now(), "updated_at": _now()}
        self._put(self._store(project), "tasks", S.TASKS, row)
        return row["id"]

    def _act(self, project: str, task: str, action: str, checkpoint: dict | None) -> dict:
        row = self._row(self.table(project, "tasks"), task, "task")
        after = self.spark.range(1).select(lifecycle.task_transition(F.lit(row["status"]), F.lit(action))).first()[0]
        if after.startswith("error"):
            raise NotAllowed(after)
        if after != row["status"] or action == "checkpoint":
            row |= {"status": after, "checkpoint": dict(EMPTY_CHECKPOINT) | (row["checkpoint"] or {}) | (checkpoint or {}), "updated_at": _now()}
            self._put(self._store(project), "tasks", S.TASKS, row)
        return row

    def task_checkpoint(self, project: str, task: str, checkpoint: dict) -> None:
        self._act(project, task, "checkpoint", checkpoint)

    def task_complete(self, project: str, task: str, checkpoint: dict | None = None) -> list[str]:
        """The ids of candidates that the task gave."""
        self._act(project, task, "complete", checkpoint)
        done = self.table(project, "tasks").where(F.col("id") == task).select("id", "goal", "checkpoint.summary", "checkpoint.risks", "checkpoint.completed")
        return self._add_candidates(project, lifecycle.task_candidates(done, self.table(project, "candidates")).drop("id", "field"))

    def task_cancel(self, project: str, task: str) -> None:
        self._act(project, task, "cancel", None)

    def task_list(self, project: str, status: str = "in_progress", limit: int = 50) -> DataFrame:
        return ingest.page(self.table(project, "tasks"), F.col("status") == status, [F.desc("updated_at"), F.col("id")], limit)

    # --- context ---

    def project_context(self, project: str, task: str, budget: int = 3000) -> dict:
        """What is known about a task, within a token budget. Only the chosen records (some 150) reach the driver."""
        row, t = self._project(project), {n: self.table(project, n) for n in TABLES}
        q = self.spark.createDataFrame([(0, task)], "query_id long, query string")
        hits = search.hybrid(t["chunks"], t["memories"], t["symbols"], t["relations"], q, context.HITS).cache()
        known = t["chunks"].select(F.lit("chunk").alias("kind"), "id", F.col("path").alias("title"), "content", F.col("path").alias("source"))
        known = known.unionByName(t["symbols"].select(F.lit("symbol").alias("kind"), "id", F.concat_ws(" ", "kind", "qualified_name").alias("title"), F.coalesce("signature", "name").alias("content"), F.col("path").alias("source")))
        known = known.unionByName(t["memories"].select(F.lit("memory").alias("kind"), "id", "title", "content", F.col("source_ref").alias("source")))
        plain = lambda df: json.loads("[" + ",".join(r[0] for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).collect()) + "]")
        relevant = plain(hits.join(known, ["kind", "id"]).orderBy("rank").drop("query_id", "rank"))
        tasks = self.spark.createDataFrame([(0, task)], "query_id long, query string")
        # without hits there is still one query to fill up for
        seeds = hits.select("query_id", "kind", "id").unionByName(tasks.select("query_id", F.lit("none").alias("kind"), F.lit("").alias("id")))
        slots = context.slots(context.ranked(context.memory_candidates(seeds, t["memories"]), t["memories"], tasks)).cache()
        chosen = lambda slot: plain(slots.where(F.col("slot") == slot).select("id", "place").join(t["memories"], "id").orderBy("place").drop("place"))
        user = self.registry.read("user_memories", S.USER_MEMORIES)
        here = self.spark.createDataFrame([(project, row["root_path"], task)], "project string, root_path string, task string")
        mine = user.join(lifecycle.applicable(user, here).select("id"), "id").withColumn("_r", context.user_memory_rank(T.text_tokens(F.lit(task)))).orderBy(F.desc("_r"), "id").limit(context.USER_MEMORIES).drop("_r")
        active = t["tasks"].join(context.task_rank(t["tasks"], task).select("id", "place"), "id").orderBy("place").drop("place")
        near = context.code_relations(hits.select("query_id", "kind", "id", "rank"), t["relations"])
        near = t["relations"].join(near.select("id", "place"), "id").orderBy("place").select(F.col("from_name").alias("from"), F.col("to_name").alias("to"), F.col("relation_type").alias("type"), F.col("path").alias("source"), F.col("start_line").alias("line"))
        n = t["memories"].where("status in ('stale', 'conflicted')").count()
        failed = t["runs"].where("status = 'failed'").count()
        warnings = [f"{n} memories are stale or conflicted and require review."] if n else []
        warnings += [f"{failed} index runs failed; project search may be incomplete."] if failed else []
        whole = {
            "project": {"id": project, "name": row["name"], "rootPath": row["root_path"]}, "task": task, "constraints": chosen("constraint"), "decisions": chosen("decision"), "lessons": chosen("lesson"),
            "userMemories": plain(mine), "activeTasks": plain(active), "relevant": relevant, "codeRelations": plain(near), "warnings": warnings,
        }
        hits.unpersist()
        slots.unpersist()
        return context.fit_budget(whole, budget)
