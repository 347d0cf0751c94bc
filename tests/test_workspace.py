"""A project's life from end to end: incremental runs, search, candidates, drift, tasks, context."""

import pytest

from marlspike.workspace import NotAllowed, Workspace

NO_VCS = {"available": False, "kind": None, "revision": None, "branch": None, "status": "", "diff": ""}


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("proj")
    (root / "README.md").write_text("# Auth\n\nDecision: refresh tokens rotate after every successful use.\n\nOther text.")
    (root / "src").mkdir()
    (root / "src/auth.ts").write_text('import { Store } from "./store";\nexport function refreshToken(id: string) {\n  return rotate(id);\n}\n')
    (root / "src/store.ts").write_text("export class Store {}\n")
    (root / ".env").write_text("A=1")
    (root / "key.txt").write_text('api_key = "abcdefghijklmnop123456"')
    w = Workspace(spark, str(tmp_path_factory.mktemp("home")), index_parts=8)
    return w, w.project_open(str(root)), root


def test_life(project):
    w, p, root = project
    run = w.project_index(p, NO_VCS)
    assert (run["scanned"], run["indexed"], run["skipped"], run["removed"]) == (4, 3, 1, 0)
    run2 = w.project_index(p, NO_VCS)
    assert (run2["scanned"], run2["indexed"], run2["skipped"], run2["candidates"]) == (4, 0, 4, [])
    # search: the symbol by name, the document by content
    top = w.project_search(p, "refreshToken", 5).collect()
    assert any(r.kind == "symbol" for r in top)
    # a candidate came from the README; accepting it makes a memory
    pending = w.memory_candidates(p).collect()
    assert [(c.path, c.type) for c in pending] == [("README.md", "decision")]
    m = w.memory_candidate_accept(p, pending[0].id)
    assert [r.id for r in w.memory_list(p).collect()] == [m]
    with pytest.raises(NotAllowed):
        w.memory_candidate_accept(p, pending[0].id)
    # a memory bound to a paragraph stays while the paragraph stands, and goes stale when it changes
    bound = w.memory_remember(p, "lesson", "Rotation", "Tokens rotate.", source_kind="file", source_ref="README.md:3")
    (root / "README.md").write_text("# New head\n\n# Auth\n\nDecision: refresh tokens rotate after every successful use.\n\nOther text.")
    assert bound not in w.project_index(p, NO_VCS)["stale"]
    assert w.table(p, "bindings").where(f"memory_id = '{bound}'").first().start_line == 5
    (root / "README.md").write_text("# Auth\n\nDecision: refresh tokens never rotate, they must expire instead.")
    run = w.project_index(p, NO_VCS)
    assert bound in run["stale"] and len(run["candidates"]) == 1
    (root / "src/store.ts").unlink()
    assert w.project_index(p, NO_VCS)["removed"] == 1 and w.table(p, "chunks").where("path = 'src/store.ts'").isEmpty()
    assert w.project_doctor(p) == []
    (root / "lost.md").write_text("soon gone")
    w.project_index(p, NO_VCS)
    w.search_update(p)
    (root / "lost.md").unlink()
    assert w.project_doctor(p) == ["files of sources: 1 missing"]
    w.project_index(p, NO_VCS | {"kind": "git", "revision": "abc"})
    assert {r.key: r.value for r in w.table(p, "vcs_state").collect()} == {"available": "false", "provider": "git", "revision": "abc", "branch": "", "status": "", "diff_hash": ""}
    assert w.project_doctor(p) == []  # the search index knows that it is behind
    w.search_update(p)
    store = w._store(p)
    part = w._index(p)["items"].where("kind = 'symbol'").first().part
    store.remove(f"index_items/part={part}")
    assert any("symbols in the search index: 1 missing" == x for x in w.project_doctor(p))
    assert w.project_doctor(p, repair=True)[-1].startswith("repaired") and w.project_doctor(p) == []
    with pytest.raises(NotAllowed):
        w.memory_remember(p, "lesson", "x", "password = abcdefghijklmnopqrst")
    assert w.project_health(p)["memories"]["stale"] >= 1


def test_tasks_context_and_export(project, tmp_path):
    w, p, _ = project
    t = w.task_start(p, "Ship the rotation of tokens")
    w.task_checkpoint(p, t, {"completed": ["We decided to rotate tokens after each use."], "risks": []})
    w.memory_remember(p, "constraint", "Local audit", "Audit records must remain on the local machine.")
    u = w.user_memory_remember("preference", "Style", "Short sentences about tokens.")
    with pytest.raises(NotAllowed):
        w.user_memory_remember("preference", "Style", "x", scope_level="workspace")
    c = w.project_context(p, "rotation of tokens and audit records", 2000)
    assert c["budget"]["usedTokens"] <= 2000 and [x["title"] for x in c["constraints"]] == ["Local audit"]
    assert [x["id"] for x in c["userMemories"]] == [u] and [x["id"] for x in c["activeTasks"]] == [t]
    assert w.project_context(p, "rotation", 500)["budget"]["usedTokens"] <= 500
    assert len(w.task_complete(p, t)) == 1 and w.task_complete(p, t) == []
    with pytest.raises(NotAllowed):
        w.task_cancel(p, t)
    w.project_export(p, str(tmp_path / "out"))
    w.project_backup(p, str(tmp_path / "backup"))
    with pytest.raises(FileExistsError):
        w.project_backup(p, str(tmp_path / "backup"))
    again = w.project_restore(str(tmp_path / "backup"), "/restored/here")
    assert w.table(again, "memories").count() == w.table(p, "memories").count()
    with pytest.raises(NotAllowed):
        w.project_delete(again, again)
    w.project_archive(again)
    with pytest.raises(NotAllowed):
        w.project_delete(again, again, purge=True)
    w.project_delete(again, again)
    assert [r.id for r in w.projects(True).collect()] == [p]
    nodes, edges = w.graph_overview(p)
    assert nodes.count() >= 2
    assert w.graph_search(p, "refresh").count() >= 1
    totals = w.graph_totals(p, types=["CALLS"])
    assert totals["nodes"] == w.table(p, "sources").count() and totals["edges"] == 0 and not totals["truncated"] and totals["types"]["IMPORTS"] == 1 and set(totals["types"]) == {"IMPORTS", "CALLS", "EXTENDS", "IMPLEMENTS"}
    assert w.graph_file(p, "src/auth.ts").first().n_symbols == 1
    a = w.table(p, "symbols").where("name = 'refreshToken'").first().id
    assert [r.id for r in w.graph_neighbours(p, a, types=["EXTENDS"])[0].collect()] == [a]
    assert w.project_portrait(p).count() >= 3
    assert w.ignore_preview(p, "*.md")["matched"] == 1


def test_sealed_backup_and_watch(project, tmp_path):
    w, p, root = project
    w.project_backup_encrypted(p, str(tmp_path / "sealed"), "open sesame")
    again = w.project_restore_encrypted(str(tmp_path / "sealed"), "/restored/sealed", "open sesame")
    for name in ("sources", "memories", "tasks"):
        rows = lambda x, name=name: sorted(map(str, w.table(x, name).collect()))
        assert rows(p) == rows(again)
    before = w.projects(True).count()
    with pytest.raises(Exception):
        w.project_restore_encrypted(str(tmp_path / "sealed"), "/restored/wrong", "open barley").table
    assert w.projects(True).count() == before
    w.watch_start(p, 100)
    assert [x["project"] for x in w.watch_list()] == [p]
    (root / "new.md").write_text("a new file")
    w.watch_flush(p)
    w.watch_flush(p)
    w.watch_stop(p)
    assert w.watch_list() == [] and not w.table(p, "sources").where("path = 'new.md'").isEmpty()
    runs = w.table(p, "runs").where("id like 'idx_watch%'").count()
    assert runs >= 1
    (root / "new2.md").write_text("another file")
    w.watch_start(p, 100)  # goes on where it stopped
    w.watch_flush(p)
    w.watch_stop(p)
    assert not w.table(p, "sources").where("path = 'new2.md'").isEmpty()
    assert w.table(p, "runs").where("id like 'idx_watch%'").count() == runs + 1


def test_stored_index(project, monkeypatch):
    """Updates derive only what changed and write only its parts, equal a rebuild, and find what a search without an index finds."""
    import os

    from marlspike.operators import index, search

    w, p, root = project
    w.search_update(p)
    assert w.search_update(p) == 0
    home = f"{w.home}/projects/{p}"
    stamps = lambda t: {d: sorted((f, os.stat(f"{home}/index_{t}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{home}/index_{t}/{d}")) for d in os.listdir(f"{home}/index_{t}") if d.startswith("part=")}
    before = {t: stamps(t) for t in index.SCHEMAS}
    (root / "docs.md").write_text("Ｒｅｆｒｅｓｈ tokens, spelled in full width, and a zebra.")
    w.project_index(p, NO_VCS)
    assert w.search_update(p) == 1
    for t in index.SCHEMAS:  # one new chunk: one part
        assert len([d for d, held in stamps(t).items() if held != before[t].get(d)]) == 1
    assert "docs.md" in [r.path for r in w.project_search(p, "zebra").join(w.table(p, "chunks"), "id").collect()]
    rows = lambda: {t: sorted(map(str, df.collect())) for t, df in w._index(p).items()}
    stepwise = rows()
    w.search_rebuild(p)
    assert stepwise == rows() and stepwise["grams"] and stepwise["postings"] and stepwise["blocks"]
    # a run without changes gives no table a new version, and a search then reads no item
    versions = {n: w._store(p).versions(n) for n in ("chunks", "symbols", "sources")}
    w.project_index(p, NO_VCS)
    assert versions == {n: w._store(p).versions(n) for n in versions}
    with monkeypatch.context() as m:
        m.setattr(index, "digests", None)
        m.setattr(index, "difference", None)
        assert w.search_update(p) == 0
    for q in ("refresh token", "refresh-token rotate", "zebra"):
        asked = w.spark.createDataFrame([(0, q)], "query_id long, query string")
        t = {n: w.table(p, n) for n in ("chunks", "memories", "symbols", "relations")}
        plain = search.hybrid(t["chunks"], t["memories"], t["symbols"], t["relations"], asked, 20).drop("query_id")
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, w.project_search(p, q).collect()))
    (root / "docs.md").unlink()
    w.project_index(p, NO_VCS)
    assert w.search_update(p) == 0 and not [r for r in rows()["postings"] if "'zebra'" in r]


def test_rebuild_can_be_cancelled_and_taken_up(project):
    from marlspike.workspace import Cancelled

    w, p, _ = project
    w.search_update(p)
    rows = lambda: {t: sorted(map(str, df.collect())) for t, df in w._index(p).items()}
    whole, asked = rows(), iter([False, True])
    with pytest.raises(Cancelled):
        w.search_rebuild(p, lambda: next(asked), at_once=4)
    assert rows() != whole
    assert w.search_update(p) > 0 and rows() == whole


def test_interrupted_update_is_repeated(project, monkeypatch):
    w, p, root = project
    w.search_update(p)
    (root / "broken.md").write_text("an okapi stands here")
    w.project_index(p, NO_VCS)
    store = type(w._store(p))
    write = store.overwrite_parts

    def dies(self, name, *a):
        if name == "index_items":
            raise OSError("lost")
        write(self, name, *a)

    with monkeypatch.context() as m:
        m.setattr(store, "overwrite_parts", dies)
        with pytest.raises(OSError):
            w.search_update(p)
    assert w.search_update(p) >= 1
    rows = {t: sorted(map(str, df.collect())) for t, df in w._index(p).items()}
    w.search_rebuild(p)
    assert rows == {t: sorted(map(str, df.collect())) for t, df in w._index(p).items()}
    (root / "broken.md").unlink()
    w.project_index(p, NO_VCS)


def test_one_index_run_at_a_time(project, monkeypatch):
    import threading

    w, p, _ = project
    begun, go, out = threading.Event(), threading.Event(), []
    monkeypatch.setattr(Workspace, "_index_run", lambda self, *a: (begun.set(), go.wait(30), {"ran": True})[2])
    t = threading.Thread(target=lambda: out.append(w.project_index(p, NO_VCS)))
    t.start()
    begun.wait(30)
    with pytest.raises(NotAllowed):
        w.project_index(p, NO_VCS)
    go.set()
    t.join()
    assert out == [{"ran": True}] and w.project_index(p, NO_VCS) == {"ran": True}
