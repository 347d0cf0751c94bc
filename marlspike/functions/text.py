"""Scalar text functions as Column expressions; all but texts that compatibility form may change stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits, patterns and word lists that results depend on.
MAX_FILE_BYTES, CHUNK_CHARS, MAX_TOKEN = 1_000_000, 4000, 128
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
TOKEN = r"[\p{L}\p{N}_-]+"
PRIVATE_KEY = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"
ASSIGNED_SECRET = r"(?i)(?:api[_-]?key|access[_-]?token|client[_-]?secret|private[_-]?key|password)\s*[:=]\s*[\"']?[A-Za-z0-9_\-/.+=]{16,}"
DOCUMENT_EXTENSIONS = [".md", ".mdx", ".rst", ".txt"]
CONFIG_EXTENSIONS = [".json", ".jsonc", ".yaml", ".yml", ".toml", ".ini", ".xml"]
TYPE_WORDS = [
    ("constraint", "must|shall|required|constraint", "不得|必须"),
    ("decision", "decision|decided|choose|chosen", "选择|决定"),
    ("issue", "fix|bug|issue|error", "问题|错误"),
    ("lesson", "lesson|learned|avoid", "经验|教训"),
]
DURABLE_WORDS = "decision|decided|must|shall|required|constraint|lesson|learned|issue|risk|architecture"
DURABLE_CJK = "决定|选择|必须|不得|约束|经验|教训|问题|风险"
KNOWLEDGE_PATH = r"(?i)(?:^|/)(?:readme|changelog|adr|decision|architecture|docs?)(?:[/._-]|$)"
KNOWLEDGE_EXTENSION = r"(?i)\.(?:md|mdx|rst|txt)$"
NOT_DURABLE = r"(?i)^(?:#{1,6}\s|```|~~~|--|(?:npm|npx|node|git)\s)"


def folds() -> tuple[str, str]:
    """What the full-text tokeniser takes lower-case letters for, as the two strings of a translation.

    By rule, not by list: a letter of the basic plane is its case folding, if that is one letter, and then the ASCII
    letter into which it decomposes with one mark, if it does; the marks of those decompositions vanish when they
    stand alone (they have no counterpart, so a translation drops them). Letters with two marks stay, as there.
    """
    marked, plain, marks = [], [], set()
    for c in map(chr, range(0x80, 0x10000)):
        if unicodedata.category(c) in ("Ll", "Lo", "Lm"):
            low = c.casefold() if len(c.casefold()) == 1 else c
            parts = unicodedata.normalize("NFD", low)
            if len(parts) == 2 and parts[0].isascii() and parts[0].isalpha():
                marked.append(c)
                plain.append(parts[0])
                marks.add(parts[1])
            elif low != c:
                marked.append(c)
                plain.append(low)
    return "".join(marked) + "".join(sorted(marks)), "".join(plain)


MARKED, PLAIN = folds()
#: Tokens of full-text search, after folding.
FTS_TOKEN = r"[\p{L}\p{N}]+"

#: Text of these characters alone is its own compatibility form; anything else goes through normalisation.
STABLE = r"^[\x00-\x7FÀ-ÿ]*$"


def word(words: str) -> str:
    """Any of the words, bounded by ASCII word boundaries as in the source's patterns."""
    return f"(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def nfkc(c: Column) -> Column:
    """A text in compatibility form. Text that cannot change stays in the JVM: a null goes to Python in its place."""
    @F.pandas_udf("string")
    def changed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.coalesce(changed(F.when(~c.rlike(STABLE), c)), c)


def sha(c: Column) -> Column:
    return F.sha2(c, 256)


def content_id(prefix: str, *parts: Column) -> Column:
    """prefix and the first 24 hex digits of the digest of the colon-joined parts."""
    return F.concat(F.lit(prefix), F.substring(sha(F.concat_ws(":", *parts)), 1, 24))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def detect_kind(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin(DOCUMENT_EXTENSIONS), "document").when(e.isin(CONFIG_EXTENSIONS), "config").otherwise("code")


def likely_secret(c: Column) -> Column:
    return c.rlike(PRIVATE_KEY) | c.rlike(ASSIGNED_SECRET)


def has_cjk(c: Column) -> Column:
    return c.rlike(f"[{CJK}]")


def ngrams(c: Column) -> Column:
    """The distinct grams of a text in compatibility form: 2- and 3-character grams of CJK runs, trigrams of other tokens."""
    low = F.lower(nfkc(c))
    cut = lambda t, n: F.transform(F.sequence(F.lit(1), F.length(t) - (n - 1)), lambda i: F.substr(t, i, F.lit(n)))
    none = F.array().cast("array<string>")
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    cjk = F.flatten(F.transform(runs, lambda t: F.concat(F.when(F.length(t) >= 2, cut(t, 2)).otherwise(none), F.when(F.length(t) >= 3, cut(t, 3)).otherwise(none))))
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(low, F.lit(TOKEN), F.lit(0))), lambda t: ~has_cjk(t) & (F.length(t) <= MAX_TOKEN))
    other = F.flatten(F.transform(tokens, lambda t: F.when(F.length(t) < 3, F.array(t)).otherwise(cut(t, 3))))
    return F.array_distinct(F.concat(cjk, other))


def identifier(c: Column) -> Column:
    return F.regexp_replace(F.lower(nfkc(c)), r"[^\p{L}\p{N}_]", "")


def query_phrases(c: Column) -> Column:
    """The phrases of a full-text query: white-space parts without other characters, empty ones dropped."""
    parts = F.transform(F.split(F.trim(c), r"\s+"), lambda p: F.regexp_replace(p, r"[^\p{L}\p{N}_-]", ""))
    return F.filter(parts, lambda p: p != "")


def fts_tokens(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, without diacritics."""
    return F.regexp_extract_all(F.translate(F.lower(c), MARKED, PLAIN), F.lit(FTS_TOKEN), F.lit(0))


def text_tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_-]+"), lambda t: F.length(t) >= 2)


def token_estimate(c: Column) -> Column:
    cjk = F.regexp_count(c, F.lit(f"[{CJK}]"))
    return F.ceil(cjk + (utf16_length(c) - cjk) / 4).cast("long")


def lines(c: Column) -> Column:
    return F.split(c, "\r?\n")


def chunk_starts(line_array: Column, limit: int = CHUNK_CHARS) -> Column:
    """0-based first lines of greedy chunks: a line joins while the UTF-16 units, counting line ends, stay within the limit."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("starts"))

    def step(acc, line):
        size = F.when(F.octet_length(line) == F.length(line), F.length(line)).otherwise(utf16_length(line)) + 1
        fits = (acc["i"] > 0) & (acc["n"] + size <= limit)
        return F.struct(F.when(fits, acc["n"] + size).otherwise(size).alias("n"), (acc["i"] + 1).alias("i"), F.when(fits, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"))

    return F.aggregate(line_array, start, step, lambda acc: acc["starts"])


def infer_type(c: Column) -> Column:
    low, out = F.lower(c), F.lit("task-summary")
    for name, words, cjk in reversed(TYPE_WORDS):
        out = F.when(low.rlike(f"{word(words)}|{cjk}"), name).otherwise(out)
    return out


def is_knowledge_source(path: Column) -> Column:
    return path.rlike(KNOWLEDGE_PATH) | path.rlike(KNOWLEDGE_EXTENSION)


def is_durable(line: Column) -> Column:
    """A line worth remembering: long enough, no heading, fence or command, with a telling word."""
    value = F.regexp_replace(trim_all(line), r"^[-*+]\s+", "")
    enough = F.length(value) >= F.when(has_cjk(value), 8).otherwise(20)
    return ~value.rlike(NOT_DURABLE) & enough & value.rlike(f"(?i){word(DURABLE_WORDS)}|{DURABLE_CJK}")


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def candidate_text(c: Column) -> Column:
    """The form that fingerprints compare."""
    return trim_all(F.regexp_replace(F.lower(nfkc(c)), r"\s+", " "))


def candidate_fingerprint(path: Column, kind: Column, text: Column) -> Column:
    return sha(F.concat_ws(":", path, kind, candidate_text(text)))


def escape_like(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\%_])", r"\\$1")


def within_root(root: Column, path: Column) -> Column:
    return (root == path) | path.startswith(F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/")))


def source_ref(c: Column) -> Column:
    """path, start and end of `path[:start[-end]]`."""
    path = F.regexp_replace(F.regexp_extract(c, r"(?s)^(.*?)(?::(\d+)(?:-(\d+))?)?$", 1), r"\\", "/")
    at = lambda k: F.expr("null").cast("int") if k is None else F.nullif(F.regexp_extract(c, r"(?s)^(.*?)(?::(\d+)(?:-(\d+))?)?$", k), F.lit("")).cast("int")
    return F.struct(path.alias("path"), at(2).alias("start_line"), F.coalesce(at(3), at(2)).alias("end_line"))


def excerpt(content: Column, start: Column, end: Column) -> Column:
    """The paragraphs around lines start..end (1-based), at most 200 lines grown, trimmed; over 4000 characters only the lines asked for, cut.

    Null if start lies outside or nothing is left.
    """
    all_lines = excerpt_lines(content)
    return let(F.struct(all_lines.alias("lines"), start.alias("start"), end.alias("end")), lambda a: let(F.struct(a["lines"].alias("lines"), blank_lines(a["lines"]).alias("blank"), a["start"].alias("start"), a["end"].alias("end")), lambda b: excerpt_of(b["lines"], b["blank"], b["start"], b["end"])))


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def excerpt_lines(content: Column) -> Column:
    return F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")


def blank_lines(all_lines: Column) -> Column:
    """The places (1-based) of blank lines; each line is looked at once."""
    return F.filter(F.transform(all_lines, lambda line, i: F.when(trim_all(line) == "", i + 1)), lambda i: i.isNotNull())


def excerpt_of(all_lines: Column, blank: Column, start: Column, end: Column) -> Column:
    """excerpt() of excerpt_lines() and their blank_lines(), both columns that are there already: lambdas name them again and again."""
    n = F.size(all_lines)
    last = F.least(n, F.greatest(start, end))
    above = F.coalesce(F.array_max(F.filter(blank, lambda i: i < start)), F.lit(0)) + 1
    above = F.greatest(above, F.least(start, last - 200))
    below = F.coalesce(F.array_min(F.filter(blank, lambda i: i > last)), n + 1) - 1
    below = F.least(below, F.greatest(last, above + 200))
    join = lambda a, b: trim_all(F.array_join(F.slice(all_lines, a, b - a + 1), "\n"))

    def told(x: Column) -> Column:
        long = F.length(x["grown"]) > 4000
        asked = F.substring(join(start, last), 1, 4000)
        out = F.struct(F.when(long, asked).otherwise(x["grown"]).alias("content"), F.when(long, start).otherwise(x["above"]).alias("start_line"), F.when(long, last).otherwise(x["below"]).alias("end_line"))
        return F.when(x["grown"] != "", out)

    place = F.struct(above.alias("above"), below.alias("below"))
    grown = lambda p: let(F.struct(p["above"].alias("above"), p["below"].alias("below"), join(p["above"], p["below"]).alias("grown")), told)
    return F.when((start >= 1) & (start <= n), let(place, grown))


def locate_excerpt(content: Column, wanted: Column, digest: Column) -> Column:
    """Lines where a bound excerpt stands now, counted in the trimmed content; null if its hash or place is gone."""
    clean = lambda c: trim_all(F.replace(c, F.lit("\r\n"), F.lit("\n")))
    body, part = clean(content), clean(wanted)
    at = F.instr(body, part)
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    start = ends(F.substr(body, F.lit(1), at - 1)) + 1
    return F.when((sha(part) == digest) & (at > 0), F.struct(start.alias("start_line"), (start + ends(part)).alias("end_line")))
