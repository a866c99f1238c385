"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a vector of word inputs (how much its presence speaks for the
label, from counts over the training documents), character inputs (the same for
its prefixes, suffixes and inner n-grams) and learned embeddings of the hashed
word and of its hashed n-grams.  The network reads windows of ``WINDOW`` words
in both directions, attention pools the states and the evidence of the words, and
a logistic layer on both scores the window; the weights of the evidence start at
one and are drawn back there, so that few labelled documents still make a usable
score; a document's score comes from the highest of all its overlapping
windows, calibrated on the training documents.  Forward and backward passes are
numpy.

Training takes a bounded sample: at most ``MAX_TOXIC`` documents of label 1 and
``MAX_CLEAN`` of label 0, those with the smallest hash of their id.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numera.llm.common import run_bounds

WINDOW, STRIDE = 32, 16
MAX_TOXIC, MAX_CLEAN = 600, 2000
HIDDEN, EMBED, BUCKETS = 8, 4, 4096
STATS = 4
#: Times that the windows to learn from are chosen anew.
TURNS = 3
#: Step of training, and weight decay: ``DECAY`` over the number of documents of label 1, evidence weights being drawn to their start.
RATE, DECAY, MOST_DECAY = 0.01, 3.0, 0.1
#: A missed document of label 1 counts as so many false alarms in the calibration.
MISSED = 2.0
DIM = STATS + 2 * EMBED
#: Words whose rows are kept; the table starts anew beyond.
MEMO = 150_000
CUT = 0.7
#: Runs longer than ``LONG`` also enter as pieces of ``PIECE`` characters, one every ``HOP``.
LONG, PIECE, HOP = 20, 8, 2
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_PART = re.compile(r"[^\W_]+")


def _key(word: str) -> str:
    """A word without punctuation at its ends, in lower case."""
    w = word.lower()
    return w if w.isalpha() else _EDGE.sub("", w)


def grams(word: str) -> list[str]:
    """Prefixes and suffixes of three to six characters, and all inner four-grams."""
    w = f"^{word}$"
    n = len(w)
    out = [w[:k] for k in range(4, min(8, n))] + [w[-k:] for k in range(4, min(7, n))]
    return out + [w[i : i + 4] for i in range(1, n - 4)]


_U = np.uint64
#: Weights of the places in an n-gram.
_PLACES = np.random.default_rng(23).integers(0, (1 << 64) - 1, 8, _U) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a hash of every code point of the words, where each word starts, how long it is)."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return _mix(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U) + _U(1)), np.cumsum(n) - n, n


def _at(points: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the n-grams of ``k`` code points that start at ``start``."""
    total = np.full(len(start), k, _U)
    for j in range(k):
        total += points[start + j] * _PLACES[j]
    return _mix(total)


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the ``grams`` of all words, the word of each, how many each word has), by word."""
    points, start, n = _points([f"^{w}$" for w in words])
    own = np.arange(len(words))
    found, of = [], []
    for k in (4, 5, 6, 7):
        x = own[n > k]
        found.append(_at(points, start[x], k))
        of.append(x)
        if k < 7:
            found.append(_at(points, start[x] + n[x] - k, k))
            of.append(x)
    inner = np.maximum(n - 5, 0)
    x = np.repeat(own, inner)
    found.append(_at(points, start[x] + 1 + np.arange(len(x)) - np.repeat(np.cumsum(inner) - inner, inner), 4))
    of.append(x)
    every, of = np.concatenate(found), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return every[order], of[order], np.bincount(of, minlength=len(words))


class GramTable:
    """Rows of n-grams by their hash: open addressing, looked up for many at once."""

    def __init__(self, names: list[str]):
        points, start, n = _points(names)
        h = np.zeros(len(names), _U)
        for k in np.unique(n):
            h[n == k] = _at(points, start[n == k], int(k))
        self.shift = _U(64 - max(4, int(2 * max(len(names), 1) - 1).bit_length()))
        self.key, self.row = np.zeros(1 << (64 - int(self.shift)), _U), np.full(1 << (64 - int(self.shift)), -1)
        self.most = 0
        left, slot = np.arange(len(names)), (h >> self.shift).astype(np.int64)
        while len(left):
            self.most += 1
            free = left[self.row[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            got = free[first]
            self.key[slot[got]], self.row[slot[got]] = h[got], got
            left = np.setdiff1d(left, got, assume_unique=True)
            slot[left] = (slot[left] + 1) % len(self.row)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row of each hash, or -1."""
        slot = (h >> self.shift).astype(np.int64)
        out = np.where(self.key[slot] == h, self.row[slot], -1)
        left = np.flatnonzero((out < 0) & (self.row[slot] >= 0))
        for _ in range(self.most - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) % len(self.row)
            x = slot[left]
            out[left] = np.where(self.key[x] == h[left], self.row[x], -1)
            left = left[(out[left] < 0) & (self.row[x] >= 0)]
        return out


def words_of(text: str | None) -> list[str]:
    """The words of a whole text: its runs without white space, each long one followed by its parts.

    The parts of a long run are its stretches of letters and digits, where it
    has several, and overlapping pieces of all of it, so every n-gram of the run
    is that of some word.
    """
    runs = (text or "").split()
    if not runs or max(map(len, runs)) <= LONG:
        return runs
    out: list[str] = []
    for w in runs:
        out.append(w)
        if len(w) > LONG:
            own = _PART.findall(w)
            if len(own) > 1:
                out += [x for x in own if len(x) <= LONG]
            out += [w[i : i + PIECE] for i in range(0, len(w) - PIECE + HOP, HOP)]
    return out


def _z(tp: np.ndarray, fp: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log odds of presence, in standard errors, bounded."""
    lo = np.log((tp + 0.5) / (n1 + 1)) - np.log((fp + 0.5) / (n0 + 1))
    return np.clip(lo / np.sqrt(1 / (tp + 0.5) + 1 / (fp + 0.5)), -6, 6) / 3


@dataclass
class Stats:
    """Document counts of words and n-grams by label (columns 0 and 1)."""

    word_at: dict[str, int]
    word_c: np.ndarray
    gram_at: dict[str, int]
    gram_c: np.ndarray
    n: tuple[int, int]

    def evidence(self, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of every word and n-gram; ``own`` takes one document of that label out of the counts."""
        n0, n1 = self.n[0] - (own == 0), self.n[1] - (own == 1)
        less = np.array([own == 0, own == 1], np.float64)
        out = []
        for c in (self.word_c, self.gram_c):
            c = np.maximum(c - less * c.any(axis=1, keepdims=True), 0)
            out.append(np.where(c.any(axis=1), _z(c[:, 1], c[:, 0], n1, n0), 0).astype(np.float32))
        return out[0], out[1]


def _hash(x: str) -> int:
    return zlib.crc32(x.encode("utf-8", "replace")) % BUCKETS


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b``, each row rounded alike wherever it stands: a BLAS rounds by a row's place, so by the texts beside this one."""
    return np.einsum("...i,i->..." if b.ndim == 1 else "...i,ij->...j", a, b)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Bidirectional GRU with attention pooling; parameters in ``p``."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        g = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"ew": g(BUCKETS, EMBED) * 3, "ec": g(BUCKETS, EMBED) * 3, "v": g(2 * HIDDEN, HIDDEN), "a": g(HIDDEN, 1)[:, 0], "o": g(2 * HIDDEN, 1)[:, 0], "ob": np.full(1, -2, np.float32)}
        # what speaks for the label draws attention and counts, until training says more
        self.p |= {"ae": np.array([1, 1, 1, 0], np.float32), "oe": np.array([1, 1, 1, 0], np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": g(DIM, 3 * HIDDEN), f"u{d}": g(HIDDEN, 2 * HIDDEN), f"n{d}": g(HIDDEN, HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def direction(self, xw: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """States (T, B, H) of one direction over projected inputs (T, B, 3H)."""
        p, h, n = self.p, HIDDEN, len(xw)
        u, c = p[f"u{d}"], p[f"n{d}"]
        state = np.zeros((xw.shape[1], h), np.float32)
        out, trace = np.zeros((n, xw.shape[1], h), np.float32), []
        times = np.matmul if keep else _product
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            x, m = xw[t], mask[t][:, None]
            zr = _sig(x[:, : 2 * h] + times(state, u))
            z, r = zr[:, :h], zr[:, h:]
            k = np.tanh(x[:, 2 * h :] + times(r * state, c))
            new = state + m * z * (k - state)
            if keep:
                trace.append((t, state, z, r, k))
            state = new
            out[t] = state
        return out, trace

    def attend(self, hs: np.ndarray, ev: np.ndarray, mask: np.ndarray, times=np.matmul):
        """Logits, and what the backward pass needs; ``hs`` is (T, B, 2H), ``ev`` (T, B, STATS) the words' evidence, pooled by the same attention."""
        p = self.p
        e = np.tanh(times(hs, p["v"]))
        s = np.where(mask > 0, times(e, p["a"]) + times(ev, p["ae"]), -1e9)
        w = np.exp(s - s.max(axis=0)) * mask
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pool, seen = (w[:, :, None] * hs).sum(axis=0), (w[:, :, None] * ev).sum(axis=0)
        return times(pool, p["o"]) + times(seen, p["oe"]) + p["ob"][0], e, w, pool, seen

    def logits(self, xf: np.ndarray, xb: np.ndarray, ev: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, _ = self.direction(xf, mask, "f", False)
        hb, _ = self.direction(xb, mask, "b", False)
        return self.attend(np.concatenate([hf, hb], axis=2), ev, mask, _product)[0]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Gradients of the logistic loss over windows ``x`` (T, B, DIM), and of ``x`` itself."""
        p, h = self.p, HIDDEN
        xw = {d: x @ p[f"w{d}"] + p[f"c{d}"] for d in "fb"}
        hs, traces = zip(*(self.direction(xw[d], mask, d, True) for d in "fb"))
        both = np.concatenate(hs, axis=2)
        ev = x[:, :, :STATS]
        logit, e, w, pool, seen = self.attend(both, ev, mask)
        prob = _sig(logit)
        dl = ((prob - y) / len(y)).astype(np.float32)
        g = {"o": pool.T @ dl, "oe": seen.T @ dl, "ob": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["o"]
        dw = (both * dpool[None]).sum(axis=2) + (ev @ p["oe"]) * dl
        dboth = w[:, :, None] * dpool[None]
        ds = w * (dw - (w * dw).sum(axis=0))
        g["a"], g["ae"] = np.einsum("tb,tbh->h", ds, e), np.einsum("tb,tbs->s", ds, ev)
        de = ds[:, :, None] * p["a"] * (1 - e * e)
        g["v"] = np.einsum("tbi,tbh->ih", both, de)
        dboth += de @ p["v"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, c = p[f"u{d}"], p[f"n{d}"]
            gx, gu, gc = np.zeros_like(xw[d]), np.zeros_like(u), np.zeros_like(c)
            carry = np.zeros((x.shape[1], h), np.float32)
            for t, prev, z, r, kk in reversed(traces[k]):
                m = mask[t][:, None]
                dn = carry + dboth[t, :, k * h : (k + 1) * h]
                dz = dn * m * (kk - prev) * z * (1 - z)
                dk = dn * m * z * (1 - kk * kk)
                rs = dk @ c.T
                dr = rs * prev * r * (1 - r)
                gc += (r * prev).T @ dk
                dzr = np.concatenate([dz, dr], axis=1)
                gu += prev.T @ dzr
                carry = dn * (1 - m * z) + rs * r + dzr @ u.T
                gx[t] = np.concatenate([dzr, dk], axis=1)
            g[f"u{d}"], g[f"n{d}"], g[f"c{d}"] = gu, gc, gx.sum(axis=(0, 1))
            g[f"w{d}"] = np.einsum("tbi,tbh->ih", x, gx)
            dx += gx @ p[f"w{d}"].T
        loss = -np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))
        return g, dx, loss


def windows(n: int) -> list[int]:
    """Starts of all overlapping windows of a text of ``n`` words; one at least."""
    return list(range(0, max(n - WINDOW, 0) + STRIDE, STRIDE)) if n > WINDOW else [0]


class Model:
    """Statistics, network and calibration; ``score`` takes texts."""

    def __init__(self, stats: Stats, net: Network, a: float = 1.0, b: float = 0.0, none: float = 0.0):
        self.stats, self.net, self.a, self.b, self.none = stats, net, a, b, none
        self._fresh()

    def __getstate__(self):
        return (self.stats, self.net, self.a, self.b, self.none)

    def __setstate__(self, s):
        self.__init__(*s)

    def _fresh(self) -> None:
        """Forget the words met; the table of projected inputs starts anew."""
        self.row: dict[str, int] = {}
        self.key_row: dict[str, int] = {}
        self.table = np.zeros((2, 1 << 14, 3 * HIDDEN), np.float32)
        self.seen = np.zeros((1 << 14, STATS), np.float32)
        if not hasattr(self, "gram_row"):
            word_z, self.gram_z = self.stats.evidence()
            self.word_z = np.append(word_z, np.float32(0))
            self.word_z[self.stats.word_at.get("", -1)] = 0
            self.gram_e = self.net.p["ec"][[_hash(g) for g in self.stats.gram_at] or [0]]
            self.word_at, self.gram_row = self.stats.word_at, GramTable(list(self.stats.gram_at))

    def vectors(self, keys: list[str]) -> np.ndarray:
        """Inputs (words, DIM) of words, from all counts."""
        n = len(keys)
        h, of, parts = gram_hashes(keys)
        row = self.gram_row.find(h)
        # the empty key has no n-gram
        own = (row >= 0) & (np.fromiter(map(len, keys), np.int64, n) > 0)[of]
        flat, known = row[own], np.bincount(of[own], minlength=n)
        parts = np.maximum(parts, 1).astype(np.float64)
        x = np.zeros((n, DIM), np.float32)
        x[:, 0] = self.word_z[[self.word_at.get(w, -1) for w in keys]]
        x[:, 3] = np.minimum([len(w) for w in keys], 20) / 20
        x[:, STATS : STATS + EMBED] = self.net.p["ew"][[_hash(w) for w in keys]]
        has = np.flatnonzero(known)
        if len(has):
            at = np.concatenate([[0], np.cumsum(known[has])[:-1]])
            z, all_known = self.gram_z[flat], known[has] == parts[has]
            top = np.maximum.reduceat(z, at)
            x[has, 1] = np.where(all_known, top, np.maximum(top, 0))
            x[has, 2] = np.add.reduceat(z, at) / parts[has]
            x[has, STATS + EMBED :] = np.add.reduceat(self.gram_e[flat], at, axis=0) / parts[has][:, None]
        return x

    def _rows(self, words: list[str]) -> np.ndarray:
        """Rows of the table for ``words``; words alike but for case and punctuation share one."""
        if len(self.row) > MEMO:
            self._fresh()
        row = self.row
        new = [w for w in set(words) if w not in row]
        if new:
            keys = [_key(w) for w in new]
            at = self.key_row
            made = [k for k in dict.fromkeys(keys) if k not in at]
            if made:
                n = len(at)
                while n + len(made) > self.table.shape[1]:
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
                    self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
                x, p = self.vectors(made), self.net.p
                for k, d in enumerate("fb"):
                    self.table[k, n : n + len(made)] = _product(x, p[f"w{d}"]) + p[f"c{d}"]
                self.seen[n : n + len(made)] = x[:, :STATS]
                at.update(zip(made, range(n, n + len(made))))
            row.update(zip(new, map(at.__getitem__, keys)))
        return np.fromiter(map(row.__getitem__, words), np.int64, len(words))

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """The highest window logit of each text, a few thousand windows at a time."""
        best = np.full(len(texts), -np.inf)
        empty = np.zeros(len(texts), bool)
        pend: list[tuple[int, list[str]]] = []
        size = 0
        for i, t in enumerate(texts):
            words = words_of(t)
            empty[i] = not words
            pend.append((i, words))
            size += len(words) + WINDOW
            if size > 120_000:
                self._score(pend, best)
                pend, size = [], 0
        self._score(pend, best)
        return np.where(empty, self.none, best)

    def _score(self, pend: list[tuple[int, list[str]]], best: np.ndarray) -> None:
        if not pend:
            return
        rows = self._rows([w for _, ws in pend for w in ws])
        at, start, end, doc = 0, [], [], []
        for i, ws in pend:
            for s in windows(len(ws)):
                start.append(at + s)
                end.append(at + min(s + WINDOW, len(ws)))
                doc.append(i)
            at += len(ws)
        start, end, doc = np.array(start), np.array(end), np.array(doc)
        rows = rows if len(rows) else np.zeros(1, np.int64)  # masked, so any row will do
        for s in range(0, len(start), 2048):
            pos = start[s : s + 2048][None, :] + np.arange(WINDOW)[:, None]
            mask = (pos < end[s : s + 2048][None, :]).astype(np.float32)
            own = rows[np.minimum(pos, len(rows) - 1)]
            logit = self.net.logits(self.table[0][own], self.table[1][own], self.seen[own], mask)
            np.maximum.at(best, doc[s : s + 2048], logit)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores from 0 to 1; a text without words scores as the median training document of label 0."""
        return _sig(self.a * self.raw(texts) + self.b)


def train(rows: list[tuple[str | None, int]], epochs: int = 15, seed: int = 5) -> Model:
    """Train on (text, label) pairs; the statistics leave a training document out of its own inputs."""
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {"": 0}
    pos, label_of = [], [int(y) for _, y in rows]
    for text, _ in rows:
        words = words_of(text)
        pos.append(np.fromiter((place.setdefault(_key(w), len(place)) for w in words), np.int32, len(words)))
    vocab = list(place)
    # the n-grams of every word, as one flat list
    gram_at: dict[str, int] = {}
    every, parts = array("i"), np.zeros(len(vocab), np.int64)
    for i, w in enumerate(vocab):
        if w:
            own = [gram_at.setdefault(g, len(gram_at)) for g in grams(w)]
            parts[i] = len(own)
            every.extend(own)
    flat, owner = np.array(every, np.int64), np.repeat(np.arange(len(vocab)), parts)
    parts = np.maximum(parts, 1)
    at = np.searchsorted(owner, np.arange(len(vocab) + 1))
    word_c, gram_c = np.zeros((len(vocab), 2)), np.zeros((len(gram_at), 2))
    for p, y in zip(pos, label_of):
        u = np.unique(p)
        word_c[u, y] += 1
        size = at[u + 1] - at[u]
        gram_c[np.unique(flat[np.repeat(at[u] - (np.cumsum(size) - size), size) + np.arange(size.sum())]), y] += 1
    # an n-gram met once says little and would only fill the table
    known = gram_c.sum(axis=1) > 1
    number = np.cumsum(known) - 1
    flat, owner = number[flat[known[flat]]], owner[known[flat]]
    at = np.searchsorted(owner, np.arange(len(vocab) + 1))
    stats = Stats(place, word_c, {g: int(number[i]) for g, i in gram_at.items() if known[i]}, gram_c[known], (label_of.count(0), label_of.count(1)))
    del gram_at, every
    net = Network(seed)
    if not stats.n[0] or not stats.n[1]:  # nothing to tell apart: the share of the label
        net.p["o"][:] = 0
        return Model(stats, net, 1.0, float(np.log((stats.n[1] + 0.5) / (stats.n[0] + 0.5))))
    # inputs of every word of the sample, for documents of either label that hold it, without that document
    size = np.diff(at)
    has, all_known = np.flatnonzero(size), size == parts
    stat = []
    for own in (0, 1):
        word_z, gram_z = stats.evidence(own)
        x = np.zeros((len(vocab), STATS), np.float32)
        x[:, 0] = word_z
        x[0, 0] = 0
        x[:, 3] = np.minimum([len(w) for w in vocab], 20) / 20
        if len(has):
            z = gram_z[flat]
            top = np.maximum.reduceat(z, at[has])
            x[has, 1] = np.where(all_known[has], top, np.maximum(top, 0))
            x[has, 2] = np.add.reduceat(z, at[has]) / parts[has]
        stat.append(x)
    hw = np.array([_hash(w) for w in vocab])
    gram_hash = np.array([_hash(g) for g in stats.gram_at], np.int64)
    flat = gram_hash[flat] if len(flat) else flat

    def spelling(own: np.ndarray):
        """Of words ``own``: the hashed n-grams, the word each belongs to, and how many n-grams a word has in all."""
        n = size[own]
        word = np.repeat(np.arange(len(own)), n)
        return flat[np.repeat(at[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())], word, parts[own][:, None]

    def inputs(own: np.ndarray, y: int) -> np.ndarray:
        x = np.zeros((len(own), DIM), np.float32)
        x[:, :STATS], x[:, STATS : STATS + EMBED] = stat[y][own], net.p["ew"][hw[own]]
        g, word, n = spelling(own)
        if len(g):
            first = run_bounds(word)[:-1]
            x[word[first], STATS + EMBED :] = np.add.reduceat(net.p["ec"][g], first, axis=0)
        x[:, STATS + EMBED :] /= n
        return x

    def scattered(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Rows of ``values`` added up by hash bucket."""
        return np.stack([np.bincount(at, v, BUCKETS) for v in values.T], axis=1).astype(np.float32)

    def peak(i: int) -> np.ndarray:
        """Starts of a document's windows, by the evidence in their words."""
        x = stat[label_of[i]][pos[i]]
        e = np.concatenate([[0], np.cumsum(np.maximum(np.maximum(x[:, 1], x[:, 0]), 0) ** 3)])
        s = np.array(windows(len(pos[i])))
        return s[np.argsort(-(e[np.minimum(s + WINDOW, len(e) - 1)] - e[np.minimum(s, len(e) - 1)]), kind="stable")]

    # all windows of all documents: document, first word and end in the joined texts
    joined = np.concatenate([*pos, np.zeros(1, np.int32)])
    base = np.concatenate([[0], np.cumsum([len(p) for p in pos])])
    of = [windows(len(p)) for p in pos]
    win_doc = np.repeat(np.arange(len(pos)), [len(w) for w in of])
    win_start = np.concatenate([np.array(w) for w in of])
    win_y = np.array(label_of)[win_doc]

    def logits(proj: list) -> np.ndarray:
        """Logits of all windows, each by the inputs that leave its document out."""
        out = np.zeros(len(win_doc))
        for y in (0, 1):
            mine = np.flatnonzero(win_y == y)
            for s in range(0, len(mine), 2048):
                own = mine[s : s + 2048]
                at_word = (base[win_doc[own]] + win_start[own])[None, :] + np.arange(WINDOW)[:, None]
                mask = at_word < base[win_doc[own] + 1][None, :]
                word = joined[np.minimum(at_word, len(joined) - 1)]
                out[own] = net.logits(proj[y][0][word], proj[y][1][word], stat[y][word], mask.astype(np.float32))
        return out

    def projected() -> list:
        every = np.arange(len(vocab))
        return [[x @ net.p[f"w{d}"] + net.p[f"c{d}"] for d in "fb"] for x in (inputs(every, y) for y in (0, 1))]

    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    t, batch = 0, 256
    rest, decay = {k: net.p[k].copy() for k in ("ae", "oe")}, min(MOST_DECAY, DECAY / stats.n[1])
    for turn in range(TURNS):
        # windows to learn from: the likeliest of a document, by the words at first, then by the network;
        # of documents of label 0 several, as none of theirs may pass
        start: list[tuple[int, int]] = []
        z = logits(projected()) if turn else None
        at_doc = np.searchsorted(win_doc, np.arange(len(pos) + 1))
        for i, y in enumerate(label_of):
            if turn:
                own = slice(at_doc[i], at_doc[i + 1])
                s = win_start[own][np.argsort(-z[own], kind="stable")]
            else:
                s = peak(i)
            start += [(i, int(k)) for k in (s[:1] if y else np.unique(np.concatenate([s[:2], rng.choice(s, 1)])))]
        n = np.array([min(WINDOW, len(pos[i]) - s) for i, s in start])
        word = np.zeros((len(start), WINDOW), np.int64)
        for j, (i, s) in enumerate(start):
            word[j, : n[j]] = pos[i][s : s + WINDOW]
        mask_all = (np.arange(WINDOW)[None, :] < n[:, None]).astype(np.float32)
        label = np.array([label_of[i] for i, _ in start], np.float32)
        for _ in range(epochs // TURNS):
            order = rng.permutation(len(label))
            for b in range(0, len(order), batch):
                own = order[b : b + batch]
                x = np.zeros((len(own), WINDOW, DIM), np.float32)
                uniq, back = np.unique(word[own], return_inverse=True)
                back = back.reshape(len(own), WINDOW)
                for y in (0, 1):
                    x[label[own] == y] = inputs(uniq, y)[back[label[own] == y]]
                g, dx, _ = net.step(np.ascontiguousarray(x.transpose(1, 0, 2)), mask_all[own].T, label[own])
                d = (dx.transpose(1, 0, 2)[:, :, STATS:] * mask_all[own][:, :, None]).reshape(-1, 2 * EMBED)
                by = np.argsort(back, axis=None, kind="stable")
                dw = np.add.reduceat(d[by], run_bounds(back.ravel()[by])[:-1], axis=0)
                spelt_as, word_of, many = spelling(uniq)
                g["ew"], g["ec"] = scattered(hw[uniq], dw[:, :EMBED]), scattered(spelt_as, (dw[:, EMBED:] / many)[word_of])
                t += 1
                for k, v in net.p.items():
                    m1, m2 = moment[k]
                    m1 += 0.1 * (g[k] - m1)
                    m2 += 0.001 * (g[k] ** 2 - m2)
                    pull = 0 if k == "ob" else decay * (v - rest.get(k, 0))
                    v -= (RATE * ((m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8) + pull)).astype(np.float32)
    # calibration over the whole training documents, each without itself in the statistics
    best = np.full(len(pos), -np.inf)
    np.maximum.at(best, win_doc, logits(projected()))
    y = np.array(label_of, np.float64)
    mid, spread = best.mean(), best.std() + 1e-6
    u, a, b = (best - mid) / spread, 1.0, 0.0
    for _ in range(400):
        e = (_sig(a * u + b) - y) * np.where(y > 0, MISSED, 1.0)
        a, b = a - 1.0 * ((e * u).mean() + 1e-3 * a), b - 1.0 * e.mean()
    return Model(stats, net, float(a / spread), float(b - a * mid / spread), float(np.median(best[y == 0])))


def held_out(c):
    """Condition: rows kept from training."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(3)) == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep=None) -> Model:
    """Fit on labelled rows, at most ``MAX_TOXIC`` and ``MAX_CLEAN`` of them.

    Ids and labels that are null, and labels other than 0 and 1, train nothing.
    Repeated labels of one id count once (the largest).  Only the texts of the
    rows chosen reach the driver.
    """
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    lab = lab.where(~held_out(F.col("doc_id")) if keep is None else keep).groupBy("doc_id").agg(F.max("y").alias("y"))
    lab = lab.withColumn("h", F.xxhash64("doc_id"))
    one = lab.where("y = 1").orderBy("h", "doc_id").limit(MAX_TOXIC)
    two = lab.where("y = 0").orderBy("h", "doc_id").limit(MAX_CLEAN)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = src.join(F.broadcast(one.union(two)), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc_id").collect()
    return train([(r.text, r.y) for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text, a row for each row.

    A null text is empty; equal texts score alike, whatever their ids; null and
    repeated ids stay as they are; extra columns are not read, whatever their
    names; an empty table gives an empty one.
    """
    # the counts come from the bounded sample, so the size is bounded too
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(b.column(1).to_pylist()).astype(np.float64))], ["doc_id", "score"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double")


def clean(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``cut``, with all their columns; repeated rows stay or go together, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(shared.value.score(b.column(at).to_pylist()) < cut))

    return docs.mapInArrow(run, docs.schema)
