"""Scanning a tree of text files: policy, content filters, kinds."""

from __future__ import annotations

import json
import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# What is ignored, sensitive, binary or generated.
IGNORED = [
    ".git/", ".hg/", ".svn/", ".marlspike/", "node_modules/", "dist/", "build/", "out/", "target/", "CMakeFiles/", "cmake-build-*/",
    "coverage/", "playwright-report/", "test-results/", ".playwright-cli/", ".next/", ".cache/", ".gradle/", ".venv/", "venv/", "__pycache__/",
    ".pytest_cache/", ".mypy_cache/", ".ruff_cache/", ".tox/", "vendor/", "*.min.js", "*.min.css", "*.map", "*.lock", "package-lock.json",
    ".ninja_deps", ".ninja_log",
]
IGNORED_IN_CODEX = [
    ".sandbox/", ".sandbox-bin/", ".sandbox-secrets/", ".tmp/", "attachments/", "browser/", "computer-use/", "computer-use-turn-ended/",
    "generated_images/", "log/", "logs/", "mcp-oauth-locks/", "node_repl/", "plugins/cache/", "process_manager/", "secrets/", "sessions/",
    "sqlite/", "tmp/", "vendor_imports/", "*.jsonl", "*.sqlite-*", ".codex-global-state.json*", "cap_sid", "models_cache.json",
]
SECRET_NAMES = [".env", ".npmrc", ".pypirc", "auth.json", "credentials.json", "secrets.json", "id_rsa", "id_ed25519"]
SECRET_EXTENSIONS = [".pem", ".key", ".p12", ".pfx", ".jks", ".keystore"]
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".gz", ".7z", ".exe", ".dll", ".so", ".dylib", ".wasm", ".db", ".sqlite",
    ".sqlite3", ".woff", ".woff2",
]
GENERATED_EXTENSIONS = [
    ".o", ".obj", ".a", ".lib", ".lo", ".la", ".pdb", ".ilk", ".exp", ".idb", ".iobj", ".ipdb", ".tlog", ".res", ".pch", ".gch", ".dwo", ".dwp",
    ".bc", ".pcm", ".ifc", ".mod", ".smod", ".gcda", ".gcno", ".profraw", ".profdata", ".class", ".jar", ".pyc", ".pyo", ".beam", ".hi",
    ".dyn_hi", ".dyn_o", ".rlib", ".rmeta",
]
DEPENDENCY_RULE = r"(?im)(?:^|\n)[^\r\n:]*\.(?:o|obj)\s*:\s*\S"
#: Read at a root, in order; the second is this engine's own.
IGNORE_FILES = (".gitignore", ".marlspike-ignore")


def sensitive(path: Column) -> Column:
    name = F.lower(T.basename(path))
    return name.isin(SECRET_NAMES) | name.startswith(".env.") | T.extension(name).isin(SECRET_EXTENSIONS) | F.lower(path).contains("/.ssh/")


def candidate_text_file(path: Column) -> Column:
    return ~T.extension(path).isin(BINARY_EXTENSIONS + GENERATED_EXTENSIONS)


def skip_reason(path: Column, content: Column, size: Column) -> Column:
    """Why a scanned file is not indexed: the first of size, binary, generated, secret; null if it is."""
    return (
        F.when(size > T.MAX_FILE_BYTES, "size")
        .when(F.instr(content, F.lit("\x00")) > 0, "binary")
        .when((T.extension(path) == ".d") & F.substring(content, 1, 16384).rlike(DEPENDENCY_RULE), "generated")
        .when(T.likely_secret(content), "secret")
    )


def policy_flags(files: DataFrame) -> DataFrame:
    """files: path, content, size_bytes. Adds kind, is_sensitive, is_text, skip_reason."""
    path = F.col("path")
    return files.withColumns({"kind": T.detect_kind(path), "is_sensitive": sensitive(path), "is_text": candidate_text_file(path), "skip_reason": skip_reason(path, F.col("content"), F.col("size_bytes"))})


def rule_pattern(rule: str) -> tuple[bool, re.Pattern] | None:
    """A line of an ignore file: whether it takes back, and a pattern over a relative path (with / after folders)."""
    line = rule.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line
    line = line[1:] if line.startswith("\\") else line
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + re.sub(r"^\[!", "[^", line[i : end + 1]), end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return back, re.compile(("^" if anchored else "(?:^|/)") + out + ("/" if folder else "(?:/|$)"))


class IgnoreRules:
    """Ignore rules in order; the last that matches wins, and nothing comes back from an ignored folder."""

    def __init__(self, rules: list[str]):
        self.lines = list(rules)
        self.rules = [r for r in map(rule_pattern, rules) if r]

    @classmethod
    def for_root(cls, root: str, more: str = "", ignore_files: tuple[str, ...] = IGNORE_FILES) -> IgnoreRules:
        name = os.path.basename(os.path.normpath(root)).lower()
        rules = list(IGNORED) + (IGNORED_IN_CODEX if name == ".codex" else [])
        for f in ignore_files:
            try:
                with open(os.path.join(root, f), encoding="utf-8") as held:
                    rules += held.read().splitlines()
            except FileNotFoundError:
                continue
        return cls(rules + more.splitlines())

    def _one(self, path: str) -> bool:
        hit = False
        for back, pattern in self.rules:
            if hit == back and pattern.search(path):
                hit = not back
        return hit

    def ignores(self, path: str) -> bool:
        parts = path.split("/")
        return any(self._one("/".join(parts[:k]) + "/") for k in range(1, len(parts))) or self._one(path)


def walk(root: str, rules: IgnoreRules) -> tuple[list[str], dict[str, int]]:
    """Relative paths of regular files, pruning ignored folders before entering them; counts of visited and pruned."""
    found, seen = [], {"visited": 0, "pruned": 0}
    for top, folders, names in os.walk(root, followlinks=False):
        where = os.path.relpath(top, root).replace(os.sep, "/")
        at = "" if where == "." else where + "/"
        stay = []
        for f in sorted(folders):
            if os.path.islink(os.path.join(top, f)):
                continue
            if rules.ignores(at + f + "/"):
                seen["pruned"] += 1
            else:
                stay.append(f)
        folders[:] = stay
        for n in sorted(names):
            if not os.path.islink(os.path.join(top, n)):
                seen["visited"] += 1
                found.append(at + n)
    return found, seen


#: Bytes of files that a task hands on at once.
AT_ONCE = 16 << 20


def _reader(base: str):
    def run(batches):
        columns = ["path", "content", "size_bytes", "modified"]
        for pdf in batches:
            rows, held = [], 0
            for path, size, modified in zip(pdf["path"], pdf["size_bytes"], pdf["modified"]):
                data = None
                if size <= T.MAX_FILE_BYTES:  # a larger file is skipped, so it is not read
                    try:
                        with open(base + path, "rb") as f:
                            data = f.read()
                    except FileNotFoundError:  # gone since it was listed
                        continue
                rows.append((path, data, size if data is None else len(data), modified))
                held += len(data or b"")
                if held > AT_ONCE:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return run


def scan(spark: SparkSession, root: str, rules: IgnoreRules | None = None) -> DataFrame:
    """path, content, content_hash, size_bytes, modified, kind, skip_reason of the files that policy lets through.

    Tasks list and prune the tree (sources.tree) and read the files that are left; the tree is mounted where executors run.
    Files over the size limit are not read: their content and hash are null. Broken UTF-8 becomes replacement characters.
    """
    from .tree import TreeSource

    rules = rules or IgnoreRules.for_root(root)
    base = os.path.abspath(root).rstrip("/") + "/"
    spark.dataSource.register(TreeSource)
    listed = spark.read.format("tree").option("root", base).option("rules", json.dumps(rules.lines)).load()
    listed = listed.where(~sensitive(F.col("path")) & candidate_text_file(F.col("path"))).repartition(spark.sparkContext.defaultParallelism)  # folders differ in size
    rows = listed.mapInPandas(_reader(base), "path string, content binary, size_bytes long, modified timestamp")
    got = rows.select("path", F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), "size_bytes", "modified")
    return got.withColumn("kind", T.detect_kind(F.col("path"))).withColumn("skip_reason", skip_reason(F.col("path"), F.col("content"), F.col("size_bytes")))


def ignore_preview(sources: DataFrame, rules: IgnoreRules) -> DataFrame:
    """How many indexed paths the rules would ignore, of how many, and the first eight by path."""
    @F.pandas_udf("boolean")
    def hit(s: pd.Series) -> pd.Series:
        return s.map(rules.ignores)

    marked = sources.select("path", hit("path").alias("m"))
    first = F.array_sort(F.collect_list(F.when(F.col("rn") <= 8, F.col("path"))))
    top = marked.where("m").orderBy("path").limit(8).withColumn("rn", F.row_number().over(Window.orderBy("path"))).agg(first.alias("sample_paths"))
    return marked.agg(F.count_if("m").alias("matched"), F.count("*").alias("total")).crossJoin(top)  # one row by one row
