"""Secret scans: fixed patterns, and spans that a linear-chain conditional random field adds.

The patterns (assign, access, hex) give base spans, leftmost and not overlapping within a kind; they always stay.
The CRF tags tokens (runs of letters, digits and a few signs) as begin, inside or outside of a secret. Its features are
the token's shape, how often its kinds of characters alternate and how many of its letters are vowels, its word, the
word on either side and the one before that, the bytes that touch it, and features of the file (language, source).
Viterbi finds the best tags; a tagged run that meets no base span becomes a span of kind crf.

Base spans are the only labels, and a field that has seen nothing else can only say what the patterns say. So labelled
pieces of text are learnt in variants as well (about MADE over all pieces, at least VARIANTS of each): the secret drawn
anew in other forms (drawn_secret: other alphabets and lengths, with prefixes, of several parts, in addresses, in armour,
in prose), what announces it replaced by other words or by none, and in its place things that are no secrets (no_secret:
numbers, dates, addresses, names of classes and constants, short digests, images as base64, words). The field learns from
the pieces (WINDOW characters on either side) around the base spans of a sample of documents, of any length, and from one
in COLD of their other pieces; both samples are taken by a hash of the text under a threshold, so no task and not the
driver holds more than the sample. One task fits the field.

It is trained by gradient ascent on the log-likelihood with forward and backward sums over padded lines; decoding works
on all tokens of all texts. Null and empty texts have no spans. Equal rows get equal spans. Very long texts are scanned
whole, as a step of their own. Language and source may be missing columns. Without any base span in the sample, or
without rows, there is nothing to learn, and only base spans are given. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_hash, discard, flat, keep, lower_ascii, span_hashes, steps, table

#: Fixed values of the contract.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX, KINDS = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}", ("assign", "access", "hex", "crf")
#: The field learns from about so many documents, and from at most about so many of their pieces.
SAMPLE, PIECES, COLD, WINDOW = 6000, 8000, 16, 200
WORDS = 1 << 13
#: Size of each feature table: shape, word, word before, word after, byte before, byte after, language, source, alternation, word two before, vowels.
SIZES = (4096, WORDS, WORDS, WORDS, 256, 256, 256, 256, 256, WORDS, 256)
LINE = 64
#: Variants of a labelled piece at least, of all of them together about, the characters around one at most; what they are made of.
VARIANTS, MADE, AROUND = 4, 4000, 80
CUES = ["credential", "bearer", "authorization", "private_key", "access_key", "client", "pwd", "passphrase", "key", "auth", "signature", "webhook", "connection", "session"]
PROSE = ["is", "was", "for {} is", "of the {} is", "will be", "has changed to", "now reads", "to {}:"]
SIGNS = [" = \"", "=\"", ": ", " ", "=", ": \"", " => '", " is "]
ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789-_"]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, sorted; compiled here so that workers need nothing else."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.I | re.A) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text)]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(out)


def token_bytes() -> np.ndarray:
    ok = np.zeros(256, bool)
    ok[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_.-")]] = True
    ok[128:] = True
    return ok


def tokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    solid = token_bytes()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    at = np.flatnonzero(start)
    return at, np.flatnonzero(end) + 1, np.searchsorted(offsets, at, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, end: np.ndarray, own: np.ndarray, lang: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Index into each of the feature tables for every token (tables x tokens)."""
    out = np.zeros((len(SIZES), len(at)), np.int64)
    if not len(at):
        return out
    kind = np.full(256, 5, np.uint8)  # lower a-f, lower other, upper, digit, sign, beyond ASCII
    kind[97:103], kind[103:123], kind[65:91], kind[48:58] = 0, 1, 2, 3
    kind[[ord(c) for c in "+/_.-"]] = 4
    sums = np.zeros((6, len(data) + 1), np.int32)
    k = kind[data]
    for c in range(6):
        np.cumsum(k == c, out=sums[c, 1:])
    n = sums[:, end] - sums[:, at]
    size = end - at
    length = np.digitize(size, [2, 4, 6, 9, 12, 16, 20, 24, 32, 40, 65, 100, 200])
    digits = np.digitize(n[3] / size, [1e-9, 0.15, 0.4, 0.999])
    out[0] = (((length * 5 + digits) * 2 + (n[0] > 0)) * 2 + (n[1] > 0)) * 2 + (n[2] > 0)
    out[0] = (out[0] * 2 + (n[4] > 0)) * 2 + (n[5] > 0)
    low = lower_ascii()[data]
    word = 1 + (span_hashes(low, at, end) % np.uint64(WORDS - 1)).astype(np.int64)
    word[(n[3] > 0) | (n[4] > 0) & (size > 20) | (size > 24)] = 0  # no word that could be seen again
    out[1] = word
    same = own[1:] == own[:-1]
    out[2, 1:][same] = word[:-1][same]
    out[3, :-1][same] = word[1:][same]
    before = at > offsets[own]
    out[4, before] = data[at[before] - 1]
    after = end < offsets[own + 1]
    out[5, after] = data[end[after]]
    out[6], out[7] = lang[own], source[own]
    turns = np.concatenate(([0], np.cumsum(np.concatenate(([0], k[1:] != k[:-1])))))
    often = (turns[end] - turns[at + 1]) / size
    out[8] = (np.digitize(often, [0.03, 0.08, 0.15, 0.25, 0.35, 0.5, 0.7]) * 14 + length) * 2 + (n[3] > 0)
    two = own[2:] == own[:-2]
    out[9, 2:][two] = word[:-2][two]
    vowel = np.zeros(256, bool)
    vowel[list(b"aeiouyAEIOUY")] = True
    vowels = np.concatenate(([0], np.cumsum(vowel[data], dtype=np.int32)))
    letters = n[0] + n[1] + n[2]
    share = (vowels[end] - vowels[at]) / np.maximum(letters, 1)
    out[10] = np.where(letters > 0, 1 + np.digitize(share, [0.08, 0.16, 0.24, 0.32, 0.45]), 0) * 14 + length
    return out % np.array(SIZES)[:, None]


def file_codes(col: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32((v or "").encode()) % 256 for v in col.to_pylist()], np.int64)


def lines_of(own: np.ndarray, longest: int = LINE) -> np.ndarray:
    """First token of each sequence: a text, cut after `longest` tokens in training."""
    place = np.arange(len(own)) - np.searchsorted(own, own)
    return np.flatnonzero(place % longest == 0)


class Field:
    """Tags 0 outside, 1 begin, 2 inside; transitions from outside to inside are ruled out."""

    def __init__(self):
        self.tables = [np.zeros((n, 3), np.float32) for n in SIZES]
        self.move = np.zeros((3, 3), np.float32)
        self.move[0, 2] = -30.0
        self.begin = np.array([0.0, 0.0, -30.0], np.float32)

    def emission(self, index: np.ndarray) -> np.ndarray:
        e = self.tables[0][index[0]]
        for k in range(1, len(SIZES)):
            e = e + self.tables[k][index[k]]
        return e

    def fit(self, index: np.ndarray, first: np.ndarray, tag: np.ndarray, rounds: int = 80, rate: float = 0.3) -> None:
        """Adagrad on the penalised log-likelihood; first: where each sequence begins."""
        size = np.diff(np.append(first, len(tag)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        steps_n = int(size.max(initial=0))
        past = [np.full_like(t, 1e-6) for t in self.tables]
        past_move = np.full((3, 3), 1e-6)
        n_seq = len(first)
        for _ in range(rounds):
            e = self.emission(index).astype(np.float64)
            alpha = np.full((len(tag), 3), 0.0)
            for t in range(steps_n):
                live = int(np.searchsorted(-size, -t, "left"))
                at = first[:live] + t
                if t == 0:
                    alpha[at] = e[at] + self.begin
                else:
                    alpha[at] = e[at] + np.logaddexp.reduce(alpha[at - 1][:, :, None] + self.move[None], axis=1)
            beta = np.zeros((len(tag), 3))
            pair = np.zeros((3, 3))
            last = first + size - 1
            logz = np.zeros(len(tag))
            z = np.logaddexp.reduce(alpha[last], axis=1)
            for t in range(steps_n - 1, 0, -1):
                live = int(np.searchsorted(-size, -t, "left"))
                at = first[:live] + t
                right = self.move[None] + (e[at] + beta[at])[:, None, :]
                pair += np.exp(alpha[at - 1][:, :, None] + right - z[:live, None, None]).sum(axis=0)
                beta[at - 1] = np.logaddexp.reduce(right, axis=2)
            for s, n, zz in zip(first, size, z):
                logz[s : s + n] = zz
            p = np.exp(alpha + beta - logz[:, None])
            grad = p
            grad[np.arange(len(tag)), tag] -= 1
            inner = np.ones(len(tag), bool)
            inner[first] = False
            at = np.flatnonzero(inner)
            seen = np.zeros((3, 3))
            np.add.at(seen, (tag[at - 1], tag[at]), 1)
            g = (pair - seen) / n_seq + 1e-3 * self.move
            g[0, 2] = 0
            past_move += g * g
            self.move -= (rate * g / np.sqrt(past_move)).astype(np.float32)
            for k, w in enumerate(self.tables):
                g = np.stack([np.bincount(index[k], weights=grad[:, c], minlength=SIZES[k]) for c in range(3)], axis=1) / n_seq + 1e-4 * w
                past[k] += g * g
                w -= (rate * g / np.sqrt(past[k])).astype(np.float32)

    def swing(self) -> float:
        """The most that moves can gain when a token's tag turns from outside to another, beside what emissions gain."""
        m, most = self.move.astype(np.float64), 0.0
        into = np.concatenate([m, self.begin[None].astype(np.float64)])  # the last row: a text begins
        onward = np.concatenate([m, np.zeros((3, 1))], axis=1)  # the last column: a text ends
        for x in range(4):
            for y in (1, 2):
                for z in range(4):
                    other = 1 if z == 2 else z  # inside can't follow outside: it would have to begin there
                    here = into[x, y] - into[x, 0] + onward[y, z] - onward[0, other]
                    most = max([most, here] + ([] if z == 3 else [here + onward[z, w] - onward[other, w] for w in range(4)]))
        return most

    def viterbi(self, index: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The best tags. A token whose outside score beats all that another tag could win is settled; settled tokens
        cut the texts into chains, and each chain is decoded exactly between its fixed neighbours."""
        e = self.emission(index).astype(np.float64)
        n = len(e)
        tag = np.zeros(n, np.int8)
        if not n:
            return tag
        m = self.move.astype(np.float64)
        turn = np.zeros(n)
        turn[:-1] = np.where(own[1:] == own[:-1], np.maximum(0, e[1:, 2] - e[1:, 1]), 0)
        at = np.flatnonzero(e[:, 0] - np.maximum(e[:, 1], e[:, 2]) <= self.swing() + turn)
        if not len(at):
            return tag
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        last = first + size - 1
        opens = np.ones(len(first), bool)
        inner = at[first] > 0
        opens[inner] = own[at[first[inner]] - 1] != own[at[first[inner]]]
        closes = np.ones(len(first), bool)
        inner = at[last] < n - 1
        closes[inner] = own[at[last[inner]] + 1] != own[at[last[inner]]]
        v, back, score = np.zeros((len(at), 3)), np.zeros((len(at), 3), np.int8), e[at]
        v[first] = score[first] + np.where(opens[:, None], self.begin[None], m[0][None])
        for t in range(1, int(size[0])):
            k = first[: int(np.searchsorted(-size, -t, "left"))] + t
            s = v[k - 1][:, :, None] + m[None]
            back[k] = s.argmax(axis=1)
            v[k] = score[k] + s.max(axis=1)
        best = np.zeros(len(at), np.int8)
        best[last] = (v[last] + np.where(closes[:, None], 0.0, m[:, 0][None])).argmax(axis=1)
        for t in range(int(size[0]) - 1, 0, -1):
            k = first[: int(np.searchsorted(-size, -t, "left"))] + t
            best[k - 1] = back[k, best[k]]
        tag[at] = best
        return tag


def scan_batch(texts: pa.Array, lang: pa.Array, source: pa.Array, field: Field | None) -> list[list[tuple[int, int, int]]]:
    """All spans (start, kind, end) of each text, in code points."""
    values = texts.fill_null("").to_pylist()
    spans = [base_spans(t) for t in values]
    if field is None:
        return spans
    data, offsets = flat(texts)
    lc, sc = file_codes(lang), file_codes(source)
    for lo, hi in steps(offsets):
        part = offsets[lo : hi + 1]
        piece, part = data[part[0] : part[-1]], part - part[0]
        at, end, own = tokenise(piece, part)
        tag = field.viterbi(features(piece, part, at, end, own, lc[lo:hi], sc[lo:hi]), own)
        hot = np.flatnonzero(tag)
        if not len(hot):
            continue
        lead = np.concatenate(([0], np.cumsum((piece & 0xC0) != 0x80)))  # code points before each byte
        open_new = np.ones(len(hot), bool)
        open_new[1:] = (tag[hot[1:]] == 1) | (hot[1:] != hot[:-1] + 1) | (own[hot[1:]] != own[hot[:-1]])
        begin = np.flatnonzero(open_new)
        for a, b in zip(begin, np.append(begin[1:], len(hot))):
            row = int(own[hot[a]])
            s = int(lead[at[hot[a]]] - lead[part[row]])
            e = int(lead[end[hot[b - 1]]] - lead[part[row]])
            base = spans[lo + row]
            if all(e <= x or s >= y for x, k, y in base if k != 3):
                base.append((s, 3, e))
    return [sorted(s) for s in spans]


def value_span(text: str, start: int, kind: int, end: int) -> tuple[int, int]:
    """The secret itself: what is assigned, or all of the span."""
    return (start + re.match(ASSIGN, text[start:end], re.I | re.A).start(2), end) if kind == 0 else (start, end)


def drawn(rng: random.Random, least: int, most: int) -> str:
    alphabet = rng.choice(ALPHABETS)
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most)))


def drawn_secret(rng: random.Random, words: list[str]) -> tuple[str, str, str]:
    """What stands before a new secret, the secret, what stands after it."""
    word = lambda: rng.choice(words).lower()
    # mostly words that announce nothing: the shape has to tell
    cue = rng.choice([rng.choice(CUES), word(), word(), ""])
    cue = cue.upper() if rng.random() < 0.2 else cue
    sign = rng.choice(SIGNS) if cue else ""
    close = "\"" if "\"" in sign else ""
    form = rng.randrange(8)
    if form < 3:
        return cue + sign, drawn(rng, 16, 56), close
    if form == 3:  # a prefix of letters, perhaps two
        heads = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 2))]
        return cue + sign, rng.choice("-_").join([*heads, drawn(rng, 16, 48)]), close
    if form == 4:  # several parts
        mark = rng.choice(".-_")
        return cue + sign, mark.join(drawn(rng, 10, 60) for _ in range(rng.randint(2, 4))), close
    if form == 5:  # in an address
        return f"{word()}://{word()}:", drawn(rng, 8, 24), f"@{word()}.{word()}:{rng.randrange(1000, 60000)}/{word()}"
    if form == 6:  # armoured lines
        label = " ".join(rng.choice(words).upper() for _ in range(rng.randint(1, 2)))
        body = "".join(rng.choice(ALPHABETS[-2]) for _ in range(64 * rng.randint(2, 5) + rng.randint(4, 60)))
        return f"-----BEGIN {label} KEY-----\n", "\n".join(body[k : k + 64] for k in range(0, len(body), 64)), f"\n-----END {label} KEY-----"
    # in prose: a cue, some words, and a short mixed one
    told = rng.choice([*CUES, "password", "passwd", "secret", "token", "passcode", "pin"])
    short = rng.choice([rng.choice(words).title() + str(rng.randrange(10, 10000)), f"{word()}{rng.randrange(10, 1000)}{word()[:3].upper()}", drawn(rng, 7, 14)])
    return f"{rng.choice(['the', 'my', 'your', 'our', 'new'])} {told} {rng.choice(PROSE).format(word())} ", short, ""


def no_secret(rng: random.Random, words: list[str]) -> str:
    """Something that is none: numbers, dates, addresses, versions, names, short digests, images, words."""
    n, word = rng.randrange, rng.choice(words)
    some = [rng.choice(words) for _ in range(n(2, 7))]
    joined = lambda mark, of=str.lower: mark.join(map(of, some))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    base64 = lambda k: "".join(rng.choice(ALPHABETS[-2]) for _ in range(k))
    return rng.choice([
        str(n(10**11)), f"20{n(100):02d}-{n(12) + 1:02d}-{n(28) + 1:02d}", f"{word.lower()}.{n(100)}@mail{n(10)}.example.com", f"v{n(20)}.{n(20)}.{n(99)}", word, word.upper(), f"{word}_{n(10)}",
        f"https://www.{word.lower()}.org/{word}/{n(1000)}", f"+{n(99)} {n(1000)} {n(10**6)}", f"{n(256)}.{n(256)}.{n(256)}.{n(256)}", word.title() + "Handler", f"{word}/{word}.py",
        joined("", str.title), joined("", str.title), joined("", str.title) + str(n(100)), joined("_"), joined("_", str.upper), joined("."), joined("/") + f".{word.lower()[:3]}", joined("-") + f"-{n(1000)}",
        f"https://{joined('.')}/{joined('-')}?{word.lower()}={n(10**6)}", f"{word.lower()}://{joined('.')}:{n(1000, 60000)}/{word.lower()}", f"{joined(' ')} commit {hexes(n(7, 13))}", f"fixed in {hexes(n(7, 13))}",
        f"{hexes(8)}-{hexes(4)}-{hexes(4)}-{hexes(4)}-{hexes(12)}", f"data:image/{rng.choice(['png', 'gif', 'jpeg', 'webp'])};base64,{base64(n(60, 400))}=", f"data:font/woff2;base64,{base64(n(60, 400))}", f"#{hexes(6)}",
        f"the {rng.choice([*CUES, 'password', 'token'])} is {word.lower()}", f"a {rng.choice(['password', 'token', 'secret'])} {joined(' ')}",
    ])


def learnt_pieces(text: str, variants: int = VARIANTS) -> list[tuple[str, list[tuple[int, int]]]]:
    """A piece with the places of its secrets, and its variants. The same piece gives the same variants."""
    found = base_spans(text)
    values = sorted({value_span(text, s, k, e) for s, k, e in found})
    out = [(text, values)]
    if not found:
        return out
    rng = random.Random(zlib.crc32(text.encode()))
    words_here = re.findall(r"[A-Za-z]{3,}", text) or ["word"]
    first = min(s for s, _, _ in found)
    last = max(e for _, _, e in found)
    for k in range(variants):
        secret = k % 3 < 2
        lead, new, tail = drawn_secret(rng, words_here) if secret else ("", no_secret(rng, words_here), "")
        head = text[max(0, first - rng.randint(0, AROUND)) : first] + lead
        made = head + new + tail + text[last : last + rng.randint(0, AROUND)]
        if secret or not base_spans(made):
            out.append((made, [(len(head), len(head) + len(new))] if secret else []))
    return out


def _pieces(batches):
    """Around each base span a piece; of the rest of the text one piece in COLD."""
    for batch in batches:
        rows = []
        for text, *file in zip(*(c.to_pylist() for c in batch.columns)):
            upto = 0
            for s, _, e in base_spans(text):
                if s >= upto:
                    upto = e + WINDOW
                    rows.append((text[max(0, s - WINDOW) : upto], *file))
            for k in range(0, len(text), 2 * WINDOW):
                piece = text[k : k + 2 * WINDOW]
                if zlib.crc32(piece.encode()) % COLD == 0 and not base_spans(text[max(0, k - WINDOW) : k + 3 * WINDOW]):
                    rows.append((piece, *file))
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string()) for c in range(3)], ["text", "lang", "source"])


def fitted(texts: list[str], langs: list, sources: list) -> Field | None:
    """The field that pieces of text teach."""
    labelled = sum(bool(base_spans(t)) for t in texts)
    variants = max(VARIANTS, MADE // max(1, labelled))
    rows = [(t, v, lang, source) for text, lang, source in sorted(zip(texts, langs, sources), key=str) for t, v in learnt_pieces(text, variants)]
    if not any(v for _, v, _, _ in rows):
        return None
    text = pa.array([t for t, _, _, _ in rows], pa.string())
    data, offsets = flat(text)
    at, end, own = tokenise(data, offsets)
    index = features(data, offsets, at, end, own, file_codes(pa.array([r[2] for r in rows], pa.string())), file_codes(pa.array([r[3] for r in rows], pa.string())))
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    tag = np.zeros(len(at), np.int64)
    for row, (_, values, _, _) in enumerate(rows):
        a, b = np.searchsorted(own, row), np.searchsorted(own, row, "right")
        begin, stop = lead[at[a:b]] - lead[offsets[row]], lead[end[a:b]] - lead[offsets[row]]
        for s, e in values:
            inside = np.flatnonzero((stop > s) & (begin < e))
            tag[a + inside[:1]] = 1
            tag[a + inside[1:]] = 2
    field = Field()
    field.fit(index, lines_of(own), tag)
    return field


def _fit(batches):
    rows = [c for b in batches for c in zip(*(c.to_pylist() for c in b.columns))]
    field = fitted(*zip(*rows)) if rows else None
    raw = None if field is None else np.concatenate([*(t.ravel() for t in field.tables), field.move.ravel(), field.begin]).astype(np.float32).tobytes()
    yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["weights"])


def restored(raw: bytes) -> Field:
    field, flat_weights, k = Field(), np.frombuffer(raw, np.float32), 0
    for part in (*field.tables, field.move, field.begin):
        part[:] = flat_weights[k : k + part.size].reshape(part.shape)
        k += part.size
    return field


def file_columns(docs: DataFrame, lang: str, source: str) -> list[Column]:
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(n) for c, n in ((lang, "lang"), (source, "source"))]


def train(docs: DataFrame, sample: int = SAMPLE, pieces: int = PIECES, lang: str = "lang", source: str = "source") -> Field | None:
    """Learns from the pieces of about `sample` documents, about `pieces` of them at most. The driver gets the weights alone."""
    slim = docs.select(F.col("text").cast("string").alias("text"), *file_columns(docs, lang, source)).where("text <> ''")
    some = by_hash(slim, ["text"], sample).dropDuplicates(["text"])  # equal texts meet within tasks first
    cut = keep(some.mapInArrow(_pieces, "text string, lang string, source string"), "pieces")
    raw = by_hash(cut, ["text"], pieces).dropDuplicates(["text"]).repartition(1).mapInArrow(_fit, "weights binary").where("weights is not null").first()
    discard(cut.sparkSession, cut.kept_at)
    return None if raw is None else restored(raw[0])


def _scan(field: Field | None):
    def run(batches):
        for batch in batches:
            found = scan_batch(batch.column(1), batch.column(2), batch.column(3), field)
            tell = lambda some: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in some)
            count = lambda kind: pa.array([sum(k == kind for _, k, _ in f) for f in found], pa.int64())
            base = [tell([x for x in f if x[1] != 3]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), count(0), count(1), count(2), pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([tell(f) for f in found], pa.string()), count(3)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

    return run


def scan(docs: DataFrame, sample: int = SAMPLE, lang: str = "lang", source: str = "source", field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_crf of every row; field: a trained one, else docs train it."""
    field = field or train(docs, sample, lang=lang, source=source)
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *file_columns(docs, lang, source))
    return slim.mapInArrow(_scan(field), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def query(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
