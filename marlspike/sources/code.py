"""Symbols and relations of TypeScript and JavaScript from one pass of a lexer with a stack of modes.

There is no parser library here, so this is an approximation of a grammar by tokens: strings, comments, regular expressions,
templates (their expressions are code again) and JSX (its braces are code again) are told apart by the mode on top of the
stack and by whether the token before ends a value. Brackets are matched while lexing. Declarations are read off the tokens:
functions, classes, interfaces, types, enums, methods, and arrow functions or function expressions bound to a name. Calls,
imports and heritage clauses become relations of the innermost symbol around them. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import RELATIONS, SYMBOLS
from ..store import settled

EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
MOST_SIGNATURE, MOST_EVIDENCE, MOST_NAME = 1000, 500, 500
_TOKEN = re.compile(r"(?P<space>\s+|//[^\n]*|/\*(?:.*?\*/|.*))|(?P<name>[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*)|(?P<number>\.?\d[\w.]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|(?P<mark>=>|\?\.(?!\d)|\.\.\.|[^\s])", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_JSX = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?=\s*/?>|\s+[A-Za-z_$][\w$:-]*\s*(?:=[\"'{]|/?>|\s)|\s*\{))")
_PARTS = {"template": re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S), "children": re.compile(r"[^<{]*")}
_KEYWORDS = set("if for while switch catch return function typeof await new with do else of in throw void delete yield case instanceof extends implements class const let var export default try finally async enum interface type import break continue debugger".split())
_MODIFIERS = set("public private protected static async readonly override get set abstract declare accessor *".split())
_IN_CLASSES = {"abstract", "public", "private", "protected", "override"}
_ELEMENT = "<element"
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", _ELEMENT: ">"}, {")", "]", "}"}


class Tokens:
    """kind, text, start and end of each token; the partner of each bracket; where the value chain that ends here began."""

    def __init__(self, code: str, jsx: bool):
        self.code, self.kind, self.start, self.end, self.pair = code, [], [], [], {}
        modes, brackets, at, n = ["code"], [], 0, len(code)
        while at < n:
            mode = modes[-1]
            if mode in _PARTS:
                at = _PARTS[mode].match(code, at).end()
                if at >= n:
                    break
                if mode == "template" and code[at] == "`":
                    modes.pop()
                    self._add("string", at, at + 1)
                    at += 1
                    continue
                if mode == "template" or code[at] == "{":
                    size = 2 if mode == "template" else 1
                    modes.append("code in " + mode)
                    brackets.append(len(self.kind))
                    self._add("{", at, at + size)
                    at += size
                    continue
                if code.startswith("</", at):
                    close = code.find(">", at)
                    at = n if close < 0 else close + 1
                    modes.pop()
                    self._left(modes, brackets, at)
                    continue
                modes.append("tag")
                at += 1
                continue
            m = _TOKEN.match(code, at)
            if m.lastgroup == "space":
                at = m.end()
                continue
            mark = m[0] if m.lastgroup == "mark" else ""
            if mode == "tag":
                at = m.end()
                if mark == "{":
                    modes.append("code in tag")
                    brackets.append(len(self.kind))
                    self._add("{", m.start(), at)
                elif mark == ">":
                    empty = code[m.start() - 1] == "/"
                    modes[-1:] = [] if empty else ["children"]
                    if empty:
                        self._left(modes, brackets, at)
                continue
            if mark == "`":
                modes.append("template")
                at += 1
                continue
            value = self.ends_value(len(self.kind) - 1)
            if mark == "/" and not value and (r := _REGEX.match(code, at)):
                self._add("string", at, r.end())
                at = r.end()
                continue
            if mark == "<" and jsx and not value and (j := _JSX.match(code, at)):
                modes.append("children" if j[0] == "<>" else "tag")
                brackets.append(len(self.kind))
                self._add(_ELEMENT, at, j.end())
                at = j.end()
                continue
            if mark in _OPEN:
                brackets.append(len(self.kind))
                if mark == "{":
                    modes.append("code")
            elif mark in _CLOSE:
                if brackets:
                    o = brackets.pop()
                    self.pair[o] = len(self.kind)
                    self.pair[len(self.kind)] = o
                if mark == "}" and len(modes) > 1:
                    modes.pop()
            self._add(m.lastgroup if not mark else mark, m.start(), m.end())
            at = m.end()
        for o in brackets:  # never closed: to the end
            self.pair[o] = len(self.kind)

    def _left(self, modes: list[str], brackets: list[int], at: int) -> None:
        """After an element's end: the outermost one is a value and has a partner, as a bracket has."""
        if modes[-1] not in _PARTS:
            if brackets:
                o = brackets.pop()
                self.pair[o], self.pair[len(self.kind)] = len(self.kind), o
            self._add("string", at - 1, at)

    def _add(self, kind: str, start: int, end: int) -> None:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)

    def text(self, i: int) -> str:
        return self.code[self.start[i] : self.end[i]] if 0 <= i < len(self.kind) else ""

    def ends_value(self, i: int) -> bool:
        if i < 0:
            return False
        k = self.kind[i]
        return k in ("number", "string", ")", "]", "}") or (k == "name" and self.text(i) not in _KEYWORDS)

    def past_type(self, i: int) -> int:
        """From the colon of a type: the token that ends it ({ of a body, =>, =, ; or a comma at its level)."""
        i, n, depth = i + 1, len(self.kind), 0
        while i < n:
            k = self.kind[i]
            if k in _OPEN:
                if k == "{" and depth == 0 and self.kind[i - 1] not in (":", "|", "&", "=>", ","):
                    return i
                i = self.pair[i]
            elif k in ("<", ">"):
                depth += 1 if k == "<" else -1
            elif depth == 0 and (k in ("=", ";", ",") or k in _CLOSE or (k == "=>" and self.kind[i - 1] != ")")):
                return i
            i += 1
        return n

    def past_generics(self, i: int) -> int:
        """The token after <...>, if there is one here."""
        if i >= len(self.kind) or self.kind[i] != "<":
            return i
        depth = 0
        for j in range(i, min(len(self.kind), i + 400)):
            depth += (self.kind[j] == "<") - (self.kind[j] == ">")
            if depth == 0:
                return j + 1
        return i

    def body(self, i: int) -> int | None:
        """Of a parameter list's ( : its body's { ; none for a signature."""
        i = self.pair.get(i, len(self.kind)) + 1
        if i < len(self.kind) and self.kind[i] == ":":
            i = self.past_type(i)
        return i if i < len(self.kind) and self.kind[i] == "{" else None


def _id(prefix: str, *parts) -> str:
    return prefix + hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:24]


def _value_end(t: Tokens, i: int) -> int:
    """The last token of an expression that begins at token i: the one before a comma, semicolon or closing bracket of its level, or before a new statement."""
    n, first = len(t.kind), i
    while i < n:
        k = t.kind[i]
        if k in _OPEN:
            i = t.pair[i]
        elif k in (",", ";") or k in _CLOSE:
            return i - 1
        if i > first and i + 1 < n and t.ends_value(min(i, n - 1)) and (t.kind[i + 1] in ("name", "string", "number") or t.kind[i + 1].startswith("@")) and "\n" in t.code[t.end[min(i, n - 1)] : t.start[i + 1]]:
            return min(i, n - 1)
        i += 1
    return n - 1


def _declared(t: Tokens) -> list[tuple[int, int, str, str, int | None]]:
    """First and last token, kind, name and body of each declaration, in order of their first tokens."""
    out, n, bound, depth = [], len(t.kind), -1, 0  # bound: the depth of brackets at which a list of variables goes on
    for i in range(n):
        word, k = t.text(i) if t.kind[i] == "name" else "", t.kind[i]
        depth += (k in _OPEN) - (k in _CLOSE)
        if word in ("const", "let", "var"):
            bound = depth
        elif depth < bound or (depth == bound and (k == ";" or word in ("function", "class", "return") and t.text(i - 1) not in ("=", "async"))):
            bound = -1
        after = t.text(i + 1)
        before = t.text(i - 1)
        if word == "function" and (not t.ends_value(i - 1) or before in ("}", ")", "async", "declare") or "\n" in t.code[t.end[i - 1] : t.start[i]]) and before not in ("=", "(", ",", "return", ":", "=>", "?", "&&", "||", "!"):
            at = i + 1 + (after == "*")
            p = t.past_generics(at + 1)
            if at < n and t.kind[at] == "name" and p < n and t.kind[p] == "(" and (b := t.body(p)) is not None:
                out.append((i - (before == "async"), t.pair[b], "function", t.text(at), b))
        elif word in ("class", "interface", "enum") and i + 1 < n and t.kind[i + 1] == "name" and before not in ("=", "(", ",", ":", "?", ".", "?.", "abstract") and after not in ("extends", "implements"):
            b = i + 2
            while b < n and t.kind[b] not in ("{", ";"):
                b = t.pair[b] + 1 if t.kind[b] in ("(", "[") else b + 1
            if b < n and t.kind[b] == "{":
                out.append((i - (word == "enum" and before == "const"), t.pair[b], word, after, b))
        elif word == "type" and i + 1 < n and t.kind[i + 1] == "name" and before not in (".", "?.", ",", "(") and (e := t.past_generics(i + 2)) < n and t.kind[e] == "=":
            out.append((i, _value_end(t, e + 1), "type", after, None))
        elif k == "name" and word not in _KEYWORDS and (before in ("const", "let", "var") or (bound == depth and before == ",")):
            e = t.past_type(i + 1) if after == ":" else i + 1
            if e < n and t.kind[e] == "=":
                v = e + 1 + (t.text(e + 1) == "async" and t.text(e + 2) not in ("=>", "."))
                p = t.past_generics(v)
                arrow = None
                if p < n and t.kind[p] == "(":
                    arrow = t.pair[p] + 1
                    arrow = t.past_type(arrow) if arrow < n and t.kind[arrow] == ":" else arrow
                elif p < n and t.kind[p] == "name":
                    arrow = p + 1
                if t.text(v) == "function":
                    q = t.past_generics(v + 1 + (t.text(v + 1) == "*"))
                    q = t.past_generics(q + 1) if q < n and t.kind[q] == "name" else q
                    if q < n and t.kind[q] == "(" and (b := t.body(q)) is not None:
                        out.append((i, t.pair[b], "function", word, None))
                elif arrow is not None and arrow < n and t.kind[arrow] == "=>":
                    out.append((i, t.pair[arrow + 1] if t.text(arrow + 1) == "{" else _value_end(t, arrow + 1), "function", word, None))
        elif k == "name" and word.lstrip("#") not in _KEYWORDS - {"type", "of", "async", "import", "delete", "catch", "with", "default", "return", "finally"} and (p := t.past_generics(i + 1)) < n and t.kind[p] == "(":
            first = i
            while t.text(first - 1) in _MODIFIERS:
                first -= 1
            lead = t.text(first - 1)
            if first == 0 or (lead in ("{", "}", ";", ",") and word not in ("catch", "with", "return", "async", "function")):
                if first and (b := t.body(p)) is not None:
                    out.append((first, t.pair[b], "method", word, b))
    return sorted(out, key=lambda d: (d[0], -d[1]))


def analyse(path: str, content: str) -> tuple[list[dict], list[dict]]:
    """The symbols and relations of one file."""
    t = Tokens(content, path.lower().endswith(("x", ".js")))
    n, breaks = len(t.kind), [m.start() for m in re.finditer("\n", content)]
    row = lambda i: bisect_right(breaks, i - 1)
    column = lambda i: i - (breaks[row(i) - 1] + 1 if row(i) else 0)
    stop = lambda i: t.end[min(i, n - 1)]
    declared, symbols, relations = _declared(t), [], []
    names, spans, around = set(), [], []
    for first, last, kind, name, b in declared:
        while around and around[-1][1] < first:
            around.pop()
        inside = [s["name"] for _, _, s in around if s["kind"] in ("class", "interface", "enum")]
        start, text = t.start[first], content[t.start[first] : stop(last)]
        qualified = "#".join([path, *inside, name])
        head = content[start : t.start[b]] if b is not None else text.split("\n", 1)[0]
        if kind == "function" and b is None and "{" in text and not head.strip():
            head = text
        s = {
            "id": _id("sym_", qualified, row(start) + 1, column(start)), "path": path, "name": name, "qualified_name": qualified, "kind": kind, "signature": head.strip()[:MOST_SIGNATURE] or None,
            "start_line": row(start) + 1, "end_line": row(stop(last) - 1) + 1, "content_hash": hashlib.sha256(text.encode()).hexdigest(),
        }
        symbols.append(s)
        spans.append((first, last, s))
        around.append((first, last, s))
        if kind == "method":  # its own name before its parameters is no call
            names.add(next(j for j in range(first, b) if t.text(j) == name and t.kind[j + 1] in ("(", "<")))

    def add(at: int, owner, to: str, kind: str, evidence: str) -> None:
        source = owner["qualified_name"] if owner else f"{path}#module"
        relations.append({"id": _id("rel_", path, source, to, kind, row(at), column(at)), "path": path, "from_id": owner["id"] if owner else None, "from_name": source, "to_name": to[:MOST_NAME], "relation_type": kind, "start_line": row(at) + 1, "evidence": evidence[:MOST_EVIDENCE]})

    for first, last, s in spans:
        if s["kind"] == "class":
            i, clause, begun = t.past_generics(first + 2), None, 0
            while i <= last and t.kind[i] != "{":
                if t.text(i) in ("extends", "implements"):
                    clause, begun = t.text(i), i
                elif clause and t.kind[i] == "name" and t.text(i - 1) not in (".", "?."):
                    e = i
                    while e < last and t.kind[e] != "{" and t.text(e) != ("implements" if clause == "extends" else "{"):
                        e += 1
                    add(t.start[begun], s, t.text(i), "EXTENDS" if clause == "extends" else "IMPLEMENTS", content[t.start[begun] : t.end[e - 1]])
                i += 1

    # one walk: the innermost symbol around each token, the beginning of each value chain, calls and imports
    begins, fresh, nth, around, types = [0] * n, [False] * n, 0, [], {"interface", "type"}
    for i in range(n):
        while around and around[-1][1] < i:
            around.pop()
        while nth < len(spans) and spans[nth][0] <= i:
            if spans[nth][1] >= i:
                around.append(spans[nth])
            nth += 1
        owner, k, word = (around[-1][2] if around else None), t.kind[i], t.text(i)
        linked = i > 1 and t.text(i - 1) in (".", "?.")
        if k == "name" or k == "string":
            begins[i], fresh[i] = (begins[i - 2], fresh[i - 2]) if linked else (i - 1, True) if t.text(i - 1) == "new" else (i, False)
        elif k in (")", "]") and i in t.pair:
            o = t.pair[i]
            begins[i] = begins[o - 1] if o and t.ends_value(o - 1) and t.kind[o - 1] != "}" else o
        else:
            begins[i] = i
        if word == "import" and k == "name" and not linked and t.text(i + 1) not in ("(", "."):
            j = i + 1
            while j < n and t.kind[j] not in ("string", ";", "=") and j < i + 2000:
                j += 1
            if j < n and t.kind[j] == "string" and content[t.start[j]] in "'\"":
                add(t.start[i], owner, t.text(j)[1:-1], "IMPORTS", content[t.start[i] : t.end[j + (t.text(j + 1) == ";")]])
        if k == "(" and i:
            callee = i - 1
            if t.kind[callee] == ">" and "\n" not in content[t.start[callee] : t.start[i]]:
                j = callee - 1
                while j > max(0, callee - 40) and t.kind[j] in ("name", ",", ".", "[", "]", "|"):
                    j -= 1
                callee = j - 1 if t.kind[j] == "<" and j else callee
            ok = t.kind[callee] in ("name", ")", "]") and (t.ends_value(callee) or t.text(callee) == "import")
            if not ok or callee in names or t.text(callee - 1) in ("function", "*") and t.text(callee - 2) in ("function", "") or (owner and owner["kind"] in types):
                continue
            if t.kind[callee] == ")" and t.text(begins[callee]) == "(" and t.text(begins[callee] - 1) in ("if", "for", "while", "switch", "catch", "with"):
                continue
            if t.text(callee - 1) == "function" or fresh[callee] or t.text(callee - 1) in _IN_CLASSES:
                continue
            if owner and owner["kind"] == "class" and begins[callee] == callee and t.text(callee - 1) in {"{", "}", ";"} | _MODIFIERS:  # a signature
                continue
            at = t.start[begins[callee]]
            add(at, owner, content[at : min(t.end[callee], at + MOST_NAME)].lstrip("@"), "CALLS", content[at : min(stop(t.pair.get(i, n - 1)), at + MOST_EVIDENCE)])
    return symbols, relations


def extract(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and relations of sources (path, content); other languages give none. Each file is read once for both."""
    code = sources.where(T.extension(F.col("path")).isin(EXTENSIONS)).select("path", "content")

    def run(batches):
        for batch in batches:
            for path, content in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                symbols, relations = analyse(path, content or "")
                yield pa.RecordBatch.from_arrays([pa.array([symbols], kinds[0]), pa.array([relations], kinds[1])], ["symbols", "relations"])

    kinds = [_arrow(SYMBOLS), _arrow(RELATIONS)]
    each = settled(code.mapInArrow(run, f"symbols array<struct<{_ddl(SYMBOLS)}>>, relations array<struct<{_ddl(RELATIONS)}>>"))
    return (each.select(F.explode(c).alias("r")).select("r.*") for c in ("symbols", "relations"))


def _ddl(columns: str) -> str:
    return ", ".join(":".join(c.split()) for c in columns.split(","))


def _arrow(columns: str) -> pa.DataType:
    return pa.list_(pa.struct([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in columns.split(",")]))
