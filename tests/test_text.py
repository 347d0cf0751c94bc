import hashlib
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from marlspike.functions import text as T
from marlspike.operators import search


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,grams",
    [
        ("ab", {"ab"}), ("abcd", {"abc", "bcd"}), ("刷新令牌", {"刷新", "新令", "令牌", "刷新令", "新令牌"}), ("x_y-z", {"x_y", "_y-", "y-z"}), ("a刷新b", {"刷新"}), ("", set()),
        ("q" * 129, set()), ("Éa", {"éa"}),
    ],
)
def test_ngrams(spark, text, grams):
    got = one(spark, text, T.ngrams)
    assert set(got) == grams and len(got) == len(grams)


def test_normalised_only_where_needed(spark):
    rows = ["plain", "café", "ﬁne ①", None, "é"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = {r.t for r in df.select(T.nfkc(F.col("t")).alias("t")).collect()}
    assert got == {None if r is None else unicodedata.normalize("NFKC", r) for r in rows}


def test_chunks(spark):
    def loop(text):
        lines, out, n = text.replace("\r\n", "\n").split("\n"), [], 0
        for k, line in enumerate(lines):
            if k and n + len(line) + 1 <= 4000:
                n += len(line) + 1
            else:
                out.append(k)
                n = len(line) + 1
        return out

    for text in ("", "a\nb", "x" * 5000 + "\ny", "\n".join(["z" * 1000] * 9), "a\r\nb\r\n" + "c" * 3996 + "\nd"):
        assert one(spark, text, lambda c: T.chunk_starts(T.lines(c))) == loop(text)


def test_paths(spark):
    for path, ext in ((".env", ""), ("a/b.TS", ".ts"), ("x.tar.gz", ".gz"), ("Makefile", ""), ("a.b/c", "")):
        assert one(spark, path, T.extension) == ext
    assert one(spark, "a.yaml", T.detect_kind) == "config"
    r = one(spark, "docs\\a.md:12-14", T.source_ref)
    assert (r.path, r.start_line, r.end_line) == ("docs/a.md", 12, 14)
    r = one(spark, "docs/a.md", T.source_ref)
    assert (r.path, r.start_line, r.end_line) == ("docs/a.md", None, None)


def test_tokens(spark):
    assert one(spark, "ab 漢字 🙂", T.token_estimate) == 2 + 2  # two CJK characters, six other UTF-16 units
    assert one(spark, "a-b  Foo.x yz", T.text_tokens) == ["a-b", "foo", "yz"]
    assert one(spark, "50%_a\\b", T.escape_like) == "50\\%\\_a\\\\b"


def test_excerpt_and_drift(spark):
    text = "head\n\none two\nthree four\n\ntail"
    df = spark.createDataFrame([(text,)], "t string")
    e = df.select(T.excerpt(F.col("t"), F.lit(3), F.lit(3)).alias("e")).first().e
    assert (e.content, e.start_line, e.end_line) == ("one two\nthree four", 3, 4)
    assert df.select(T.excerpt(F.col("t"), F.lit(9), F.lit(9)).alias("e")).first().e is None
    digest = hashlib.sha256(e.content.encode()).hexdigest()
    at = df.select(T.locate_excerpt(F.concat(F.lit("new\n"), "t"), F.lit(e.content), F.lit(digest)).alias("a")).first().a
    assert (at.start_line, at.end_line) == (4, 5)
    assert df.select(T.locate_excerpt(F.lit("gone"), F.lit(e.content), F.lit(digest)).alias("a")).first().a is None


def test_bm25_equals_full_text_search(spark):
    """Against SQLite's own full-text search, with phrases over - and _, repeated words and marked letters."""
    rows = [
        ("1", "read me", "the cat sat on the mat the end"), ("2", "élan vital", "a dog-house and a cat_house"), ("3", "cat", "house dog house"), ("4", "x", ""), ("5", "notes", "dog house dog house cat"), ("6", "empty", "nothing of note"), ("7", "more", "some other words"),
    ]
    asked = ["cat", "dog-house cat", "elan", "the the mat", "cat_house dog", "zebra", "house notes x"]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, path, content, tokenize='unicode61')")
    db.executemany("INSERT INTO f VALUES (?, ?, ?)", rows)
    items = spark.createDataFrame(rows, "id string, path string, content string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    weights = {"path": 2.0, "content": 1.0}
    got = {(r.query_id, r.id): r.bm25 for r in search.bm25(search.postings(items, weights), search.lengths(items, weights), q).collect()}
    want = {}
    for k, text in enumerate(asked):
        match = " OR ".join(f'"{p}"' for p in text.split())
        want |= {(k, i): s for i, s in db.execute("SELECT id, bm25(f, 0, 2, 1) FROM f WHERE f MATCH ?", (match,))}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_compatibility_forms(spark):
    """Full-width and composed forms are found, named and fingerprinted like their plain ones; Latin text is left alone."""
    rows = [("ｒｅｆｒｅｓｈ　Ｔｏｋｅｎ", "refresh Token"), ("ｶﾀｶﾅ", "カタカナ"), ("ﬁle №5", "file No5"), ("plain ascii", "plain ascii"), ("é ñ ß", "é ñ ß"), ("①②", "12")]
    df = spark.createDataFrame(rows, "a string, b string")
    same = lambda f: [r[0] for r in df.select(f(F.col("a")).eqNullSafe(f(F.col("b")))).collect()]
    for f in (T.ngrams, T.identifier, T.candidate_text, lambda c: T.candidate_fingerprint(F.lit("p"), F.lit("k"), c)):
        assert all(same(f))
    assert [r[0] for r in df.select(T.nfkc(F.col("a"))).collect()] == [b for _, b in rows]
    assert spark.createDataFrame([(None,)], "a string").select(T.nfkc(F.col("a"))).first()[0] is None


def test_chunks_count_utf16_units(spark):
    line = "🙂" * 1999  # 3998 units and a line end
    df = spark.createDataFrame([(f"{line}\nab",), ("🙂" * 1000 + "\n" + "é" * 2000,), ("x" * 1999 + "\n" + "é" * 1999,)], "content string")
    got = [r[0] for r in df.select(T.chunk_starts(T.lines(F.col("content")))).collect()]
    assert got == [[0, 1], [0, 1], [0]]


def test_folding_equals_full_text_search(spark):
    """Czech, Polish, Turkish, Vietnamese, Greek and Russian rows, and every letter of the basic plane, as SQLite's tokeniser has them."""
    rows = ["Příliš žluťoučký kůň úpěl ďábelské ódy", "Zażółć gęślą jaźń", "İstanbul'da ılık bir gün, ŞİŞLİ ğüşöç", "Tiếng Việt có dấu", "Ὀδυσσεύς ΟΔΟΣ οδός", "Ёлка и йод", "e\u0301lan a\u0328 o\u0305x ǅ ﬀ ſtraße ÅNGSTRÖM K", "日本語 が ガ 각"]
    # letters of Unicode 3.2, which the tokeniser's tables surely have
    every = [chr(c) for c in range(0x80, 0x3000) if unicodedata.ucd_3_2_0.category(chr(c)) in ("Lu", "Ll", "Lt")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table t using fts5(x, tokenize='unicode61')")
    con.execute("create virtual table v using fts5vocab(t, 'instance')")
    texts = rows + [f"q{c}w" for c in every]
    con.executemany("insert into t(rowid, x) values(?, ?)", list(enumerate(texts)))
    want = {k: [] for k in range(len(texts))}
    for term, doc, _ in con.execute("select term, doc, offset from v order by doc, offset"):
        want[doc].append(term)
    df = spark.createDataFrame(list(enumerate(texts)), "k int, x string")
    got = {r.k: r.t for r in df.select("k", T.fts_tokens(F.col("x")).alias("t")).collect()}
    bad = [(texts[k], want[k], got[k]) for k in want if want[k] != got[k]]
    assert bad == [], bad[:20]
