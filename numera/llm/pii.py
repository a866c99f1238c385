"""Personal data by patterns and a linear-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
On top of them a conditional random field over word-shape features labels the
words of every text; what it finds outside the base spans is added.  It is
trained from the small table ``labelled_rows`` builds from a seed, and decoded
by Viterbi in numpy batches.

A word whose score for "outside" exceeds every other label's by more than any
two transitions can make up is outside on the best path whatever surrounds it.
Such words split a text exactly, so only the stretches between them are decoded.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the field finds, listed after the base kinds.
MORE = ("secret",)
LABELS = ["O", *(f"{p}-{k}" for k in (*KINDS, *MORE) for p in "BI")]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
WORD = re.compile(r"\S+")
MEMO = 300_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        nxt = at
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = nxt = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(nxt, at + 1))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    first = re.search("[0-9]", text)
    if first:
        at = first.start()
        out += [("ip", *m.span()) for m in IP.finditer(text, at) if all(len(d := p.lstrip("0")) < 4 and int(d or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text, at):
            if 13 <= len(m[0]) <= 40 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


_CUES = {w: i for i, ws in enumerate(("token key secret password passwd apikey api_key pwd auth", "phone tel call mobile fax", "card visa mastercard amex", "mail email e-mail contact", "ip host address")) for w in ws.split()}
NAMES = ["bias", "alpha", "digits", "at", "dotted4", "d1-4", "d5-8", "d9-12", "d13-19", "d20+", "plus", "paren", "dashed", "groups", "hexmix", "quoted", "equals", "dotted", "upper", "len20+", "prefix+", "cue0", "cue1", "cue2", "cue3", "cue4", "mixed", "luhn", "octets", "domain"]
FEATURE = {n: i for i, n in enumerate(NAMES)}
_STRIP = "\"'`.,;:!?()[]{}<>|*#$%&"


def shape(word: str) -> tuple[int, ...]:
    """The word-shape features of one word."""
    core = word.strip(_STRIP)
    if core.isalpha():
        cue = _CUES.get(core.lower())
        return (0, 1) if cue is None else (0, 1, FEATURE[f"cue{cue}"])
    f = [0]
    on = lambda n: f.append(FEATURE[n])
    d = sum("0" <= c <= "9" for c in core)
    letters = sum(c.isalpha() for c in core)
    if d:
        on("digits")
        on("d1-4" if d < 5 else "d5-8" if d < 9 else "d9-12" if d < 13 else "d13-19" if d < 20 else "d20+")
    if "@" in core:
        on("at")
        if "." in core.rpartition("@")[2]:
            on("domain")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts):
        on("dotted4")
        if all(len(p) < 4 and int(p) <= 255 for p in parts):
            on("octets")
    elif len(parts) > 1:
        on("dotted")
    if word.lstrip("\"'([").startswith("+"):
        on("plus")
    if re.fullmatch(r"\(\d+\)", word.strip("\"'.,;:!?[]{}")):
        on("paren")
    if re.fullmatch(r"\d+(?:-\d+)+", core):
        on("dashed")
    if letters and d and min(letters, d) >= 3 and len(core) >= 16 and core.isalnum():
        on("hexmix")
    elif letters and d:
        on("mixed")
    if word[:1] in "\"'`":
        on("quoted")
    if word.strip(_STRIP) in ("=", ":=", "") and ("=" in word or ":" in word):
        on("equals")
    if core.isupper():
        on("upper")
    if len(core) >= 20:
        on("len20+")
    if 13 <= d <= 19 and not letters and luhn(_digits(core)):
        on("luhn")
    return tuple(f)


def labelled_rows(count: int = 300, seed: int = 23) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: (words, label of each word)."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["er", "on", "th", "an", "re", "eau", "ung", "ión", "ti", "é", "ble", "st"]) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = num(15)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def tail(x: str) -> str:
        return x + r.choice(["", "", "", ".", ",", "!!", "***", "%%%"])

    rows = []
    for _ in range(count):
        words: list[str] = []
        labels: list[str] = []

        def put(kind: str, *ws: str) -> None:
            for i, w in enumerate(ws):
                words.append(w)
                labels.append("O" if kind == "O" else f"{'B' if not i else 'I'}-{kind}")

        for _ in range(r.randint(1, 5)):
            for _ in range(r.randint(0, 6)):
                put("O", tail(word().capitalize() if r.random() < 0.2 else word()))
            k = r.random()
            if k < 0.12:
                put("email", tail(f"{word()}{r.choice(['', '.' + word(), num(2)])}@{word()}{r.choice(['', num(1)])}.{r.choice(['example.com', 'example.org', 'net'])}"))
            elif k < 0.22:
                put("ip", tail(".".join(str(r.randint(1, 254)) for _ in range(4))))
            elif k < 0.34:
                c = card()
                put("card", tail(c)) if r.random() < 0.6 else put("card", *[c[i : i + 4] for i in range(0, 16, 4)])
            elif k < 0.48:
                if r.random() < 0.7:
                    put("phone", f"+{r.randint(1, 99)}", f"({num(3)})", tail(f"{num(3)}-{num(4)}"))
                else:
                    put("phone", f"+{r.randint(1, 99)}-{num(3)}-{num(3)}-{num(4)}")
            elif k < 0.66:
                secret = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([20, 32, 40, 40, 64])))
                secret = secret if r.random() < 0.7 else secret.upper()
                put("O", r.choice(["token", "key", "secret", "password", "TOKEN", "api_key"]))
                put("O", r.choice(["=", ":"]))
                put("secret", r.choice([f'"{secret}"', f"'{secret}'", secret]))
            elif k < 0.74:  # near misses
                put("O", tail(r.choice([num(r.randint(1, 8)), f"{num(1)}.{num(1)}", f"v{num(1)}.{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", "=", "@", "CC", "4.0.", f"{num(3)},{num(3)}", word().upper(), f"({num(4)})", num(12), num(22), "|", "x" + num(3)])))
            elif k < 0.78:
                put("O", r.choice(["token", "key", "phone", "card", "address"]), word())
        if words:
            rows.append((words, labels))
    return rows


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - m).sum(axis=axis)) + m.squeeze(axis)


@lru_cache(maxsize=1)
def train(count: int = 300, seed: int = 23, steps: int = 140, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (features, labels) and transitions, by gradient ascent on the conditional likelihood.

    A chain starts and ends outside, so row and column "O" also serve its ends.
    """
    rows = labelled_rows(count, seed)
    n, t, k, f = len(rows), max(len(w) for w, _ in rows), len(LABELS), len(NAMES)
    x, y = np.zeros((t, n, f), np.float32), np.zeros((t, n), np.int64)
    mask = np.zeros((t, n), bool)
    for j, (ws, ls) in enumerate(rows):
        for i, (w, lab) in enumerate(zip(ws, ls)):
            x[i, j, list(shape(w))] = 1
            y[i, j], mask[i, j] = LABELS.index(lab), True
    onehot = np.eye(k)[y] * mask[..., None]
    seen_w = np.einsum("tnf,tnk->fk", x, onehot)
    length = mask.sum(axis=0)
    every = np.arange(n)
    prev = np.where(np.arange(t)[:, None] > 0, np.vstack([np.zeros((1, n), np.int64), y[:-1]]), 0)
    seen_t = np.zeros((k, k))
    np.add.at(seen_t, (prev[mask], y[mask]), 1)
    np.add.at(seen_t, (y[length - 1, every], 0), 1)
    w, tr = np.zeros((f, k)), np.zeros((k, k))
    vw, vt = np.zeros_like(w), np.zeros_like(tr)
    for _ in range(steps):
        em = x @ w
        a, b = np.zeros((t, n, k)), np.zeros((t, n, k))
        a[0] = tr[0] + em[0]
        for i in range(1, t):
            a[i] = np.where(mask[i][:, None], _logsum(a[i - 1][:, :, None] + tr[None], 1) + em[i], a[i - 1])
        b[t - 1] = tr[:, 0]
        for i in range(t - 2, -1, -1):
            b[i] = np.where(mask[i + 1][:, None], _logsum(tr[None] + (em[i + 1] + b[i + 1])[:, None, :], 2), tr[:, 0])
        z = _logsum(a[t - 1] + tr[:, 0], 1)
        gamma = np.exp(a + b - z[None, :, None]) * mask[..., None]
        gt = np.zeros((k, k))
        gt[0] += gamma[0].sum(axis=0)
        for i in range(1, t):
            q = np.exp(a[i - 1][:, :, None] + tr[None] + (em[i] + b[i])[:, None, :] - z[:, None, None])
            gt += (q * mask[i][:, None, None]).sum(axis=0)
        gt[:, 0] += gamma[length - 1, every].sum(axis=0)
        gw = (seen_w - np.einsum("tnf,tnk->fk", x, gamma)) / n - ridge * w
        gt = (seen_t - gt) / n - ridge * tr
        vw, vt = 0.9 * vw + gw, 0.9 * vt + gt
        w, tr = w + 0.3 * vw, tr + 0.3 * vt
    return w, tr


class Field:
    """Decodes texts with trained weights."""

    def __init__(self, w: np.ndarray, tr: np.ndarray):
        self.w, self.tr = w, tr
        self.swing = 2 * float(tr.max() - tr.min())
        self.rows: list[np.ndarray] = []
        self.shapes: dict[tuple[int, ...], int] = {}
        self.memo: dict[str, int] = {}

    def _word(self, word: str) -> int:
        """-1 for a word that is outside whatever surrounds it, else its row of emission scores."""
        s = shape(word)
        got = self.shapes.get(s)
        if got is None:
            em = self.w[list(s)].sum(axis=0)
            got = -1 if em[0] - em[1:].max() > self.swing else len(self.rows)
            if got >= 0:
                self.rows.append(em)
            self.shapes[s] = got
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(word) < 64:
            self.memo[word] = got
        return got

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """Per text the (kind, start, end) of the labelled runs, trimmed of surrounding punctuation."""
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        stretches: list[tuple[int, list[tuple[int, int]], list[int]]] = []
        get, make = self.memo.get, self._word
        for n, text in enumerate(texts):
            rows = [get(w) for w in text.split()]
            if None in rows:
                rows = [make(w) if (r := get(w)) is None else r for w in text.split()]
            if max(rows, default=-1) < 0:
                continue
            at = [m.span() for m in WORD.finditer(text)]
            i = 0
            while i < len(rows):
                if rows[i] < 0:
                    i += 1
                    continue
                j = i
                while j < len(rows) and rows[j] >= 0:
                    j += 1
                stretches.append((n, at[i:j], rows[i:j]))
                i = j
        if not stretches:
            return out
        table = np.array(self.rows)
        stretches.sort(key=lambda s: len(s[2]))
        i = 0
        while i < len(stretches):
            size, j = len(stretches[i][2]), i
            while j < len(stretches) and len(stretches[j][2]) == size and j - i < 4096:
                j += 1
            path = self.viterbi(table[np.array([s[2] for s in stretches[i:j]])])
            for (n, at, _), labels in zip(stretches[i:j], path):
                out[n] += self._runs(texts[n], at, labels)
            i = j
        return out

    def viterbi(self, em: np.ndarray) -> np.ndarray:
        """Best label paths (B, T) of emissions (B, T, K) between words that are outside."""
        score = self.tr[0] + em[:, 0]
        back = np.zeros(em.shape, np.int8)
        for t in range(1, em.shape[1]):
            step = score[:, :, None] + self.tr[None]
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + em[:, t]
        last = (score + self.tr[:, 0]).argmax(axis=1)
        path = np.zeros(em.shape[:2], np.int64)
        every = np.arange(len(em))
        for t in range(em.shape[1] - 1, -1, -1):
            path[:, t] = last
            last = back[every, t, last]
        return path

    @staticmethod
    def _runs(text: str, at: list[tuple[int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
        found: list[tuple[str, int, int]] = []
        for (s, e), lab in zip(at, labels):
            name = LABELS[lab]
            if name == "O":
                continue
            start, kind = name.split("-")
            if start == "I" and found and found[-1][0] == kind and not text[found[-1][2] : s].strip():
                found[-1] = (kind, found[-1][1], e)
            else:
                found.append((kind, s, e))
        out = []
        for kind, s, e in found:
            while s < e and text[s] in (_STRIP.replace("(", "") if kind == "phone" else _STRIP):
                s += 1
            while s < e and text[e - 1] in _STRIP:
                e -= 1
            if s < e:
                out.append((kind, s, e))
        return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """Per text: the base spans, and all spans; the field's are added where they overlap no base span."""
    out = []
    order = {k: i for i, k in enumerate((*KINDS, *MORE))}
    for text, more in zip(texts, field.spans(texts)):
        base = base_spans(text)
        extra = [x for x in more if all(x[2] <= s or x[1] >= e for _, s, e in base)]
        out.append((base, sorted(base + extra, key=lambda x: (order[x[0]], x[1]))))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): lists of (kind, start, end) in code points for every whole text.

    A null text is empty.  Repeated rows keep their rows; extra columns are not read.
    An empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(train())  # a few kilobytes
    one = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches):
        field = Field(*model.value)
        for b in batches:
            found = all_spans([t or "" for t in b.column(1).to_pylist()], field)
            cols = [pa.array([[{"kind": k, "start": s, "stop": e} for k, s, e in x[i]] for x in found], pa.list_(one)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "base", "spans"])

    kind = "array<struct<kind:string,start:int,stop:int>>"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind in brackets; null texts stay null, repeated rows stay, an empty table stays empty."""
    model = docs.sparkSession.sparkContext.broadcast(train())
    at = docs.columns.index(text_col)

    def clean(text: str, spans: list) -> str:
        last, out = 0, []
        for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
            if s >= last:
                out += [text[last:s], f"[{kind.upper()}]"]
            last = max(last, e)
        return "".join([*out, text[last:]]) if spans else text

    def run(batches):
        field = Field(*model.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            found = all_spans([t or "" for t in texts], field)
            new = pa.array([None if t is None else clean(t, x[1]) for t, x in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:at], new, *b.columns[at + 1 :]], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
