"""Version-control output: status lines, unified diffs, and snapshots taken by the driver."""

from __future__ import annotations

import hashlib
import subprocess

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def _clean(path):
    return F.regexp_replace(F.regexp_replace(path, '^"|"$', ""), r"\\", "/")


def status_lines(outputs: DataFrame) -> DataFrame:
    """outputs: kind (git, hg, svn), value (what status printed). One row a change: kind, line_no, status, path."""
    rows = outputs.select("kind", F.posexplode(T.lines(F.col("value"))).alias("line_no", "line")).where("line <> ''")
    or_unknown = lambda c: F.when(c == "", "?").otherwise(c)
    cut = lambda a, n: F.substring("line", a, n)
    git = T.trim_all(cut(4, 1 << 30))
    git = F.when(git.contains(" -> "), F.substring_index(git, " -> ", -1)).otherwise(git)
    path = F.when(F.col("kind") == "git", git).when(F.col("kind") == "hg", T.trim_all(cut(3, 1 << 30))).otherwise(T.trim_all(cut(9, 1 << 30)))
    status = F.when(F.col("kind") == "git", or_unknown(T.trim_all(cut(1, 2)))).when(F.col("kind") == "hg", or_unknown(T.trim_all(cut(1, 1)))).otherwise(or_unknown(T.trim_all(cut(1, 7))))
    summary = (F.col("kind") == "svn") & F.col("line").rlike("(?i)^Status against revision:")
    out = rows.where(~summary).select("kind", "line_no", status.alias("status"), path.alias("raw"))
    return out.where("kind = 'git' or raw <> ''").select("kind", "line_no", "status", _clean(F.col("raw")).alias("path"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """diffs: diff_id, diff. Rows diff_id, line_no, path, line: trimmed added lines under each header, comments dropped."""
    rows = diffs.select("diff_id", F.posexplode(T.lines(F.col("diff"))).alias("line_no", "line"))
    header = F.col("line").startswith("+++ ")
    name = T.trim_all(F.substring_index(F.substring("line", 5, 1 << 30), "\t", 1))
    rows = rows.withColumn("header", F.when(header, F.when(name == "/dev/null", "").otherwise(F.regexp_replace(name, "^b/", ""))))
    order = Window.partitionBy("diff_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.last("header", ignorenulls=True).over(order))
    text = T.trim_all(F.substring("line", 2, 1 << 30))
    rows = rows.where(F.col("line").startswith("+") & ~F.col("line").startswith("+++") & (F.col("path") != "")).select("diff_id", "line_no", "path", text.alias("line"))
    return rows.where("line <> '' and not startswith(line, '//') and not startswith(line, '*')")


COMMANDS = {
    "git": {"probe": ["rev-parse", "--is-inside-work-tree"], "revision": ["rev-parse", "HEAD"], "branch": ["rev-parse", "--abbrev-ref", "HEAD"], "status": ["status", "--porcelain"], "diff": ["diff", "HEAD"]},
    "hg": {"probe": ["root"], "revision": ["id", "-i"], "branch": ["branch"], "status": ["status"], "diff": ["diff", "--git"]},
    "svn": {"probe": ["info"], "revision": ["info", "--show-item", "revision"], "branch": ["info", "--show-item", "relative-url"], "status": ["status", "--ignore-externals", "."], "diff": ["diff", "--internal-diff", "."]},
}


def _run(kind: str, args: list[str], root: str) -> str:
    return subprocess.run([kind, *args], cwd=root, capture_output=True, text=True, timeout=15, check=True).stdout


def snapshot(root: str, run=_run) -> dict:
    """The first version control that answers in root: kind, revision, branch, status and diff; run can be replaced."""
    for kind, commands in COMMANDS.items():
        try:
            run(kind, commands["probe"], root)
        except (OSError, subprocess.SubprocessError):
            continue
        got = {}
        for name in ("revision", "branch", "status", "diff"):
            try:
                got[name] = run(kind, commands[name], root)
            except (OSError, subprocess.SubprocessError):
                got[name] = ""
        revision, branch = got["revision"].strip(), got["branch"].strip()
        revision = revision.removesuffix("+") if kind == "hg" else revision
        branch = (branch.removeprefix("^/") or "/") if kind == "svn" and branch else branch
        return {"available": True, "kind": kind, "revision": revision or None, "branch": branch or None, "status": got["status"], "diff": got["diff"]}
    return {"available": False, "kind": None, "revision": None, "branch": None, "status": "", "diff": ""}


def state(snapshot: dict) -> dict[str, str]:
    """What is kept of a snapshot, by key; the diff as its digest."""
    diff = snapshot.get("diff") or ""
    return {
        "available": str(bool(snapshot["available"])).lower(), "provider": snapshot["kind"] or "", "revision": snapshot["revision"] or "", "branch": snapshot["branch"] or "", "status": snapshot["status"] or "",
        "diff_hash": hashlib.sha256(diff.encode()).hexdigest() if diff else "",
    }
