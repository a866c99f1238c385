"""Runs of repeated words against every period tried in turn."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from numera.llm import periodic, registry


def brute(w, words=24, periods=3):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            e = i + q
            smaller = any(p < q and all(w[k] == w[k + p] for k in range(s, e - p)) for p in range(1, q))
            if e - s >= max(words, periods * q) and not smaller:
                out.append((s, e - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs():
    r = random.Random(1)
    for _ in range(700):
        n, a = r.randrange(0, 80), r.choice([1, 2, 3, 4])
        w = [r.randrange(a) for _ in range(n)]
        if n and r.random() < 0.6:
            x, p = r.randrange(n), r.randrange(1, n + 1)
            w = w[:x] + [w[x + (i - x) % p] if x + (i - x) % p < n else 9 for i in range(x, n)]
        for words, periods in ((24, 3), (3, 3), (5, 4)):
            assert periodic.find_runs(w, words, periods) == brute(w, words, periods), w
    with pytest.raises(ValueError):
        periodic.find_runs([1, 1], 2, 2)


def test_hashes_that_collide(monkeypatch):
    """Whatever the hashes say is checked word by word."""
    monkeypatch.setattr(periodic, "_MOD", 7)
    r = random.Random(5)
    for _ in range(150):
        w = [r.randrange(3) for _ in range(r.randrange(10, 40))] * r.randrange(1, 5)
        assert periodic.find_runs(w) == brute(w)


def test_long_texts():
    """Repetitive texts of many words take time in proportion to their length, but for a logarithm."""
    a, b = "a", "ab"
    while len(b) < 100_000:
        a, b = b, b + a
    start = time.time()
    assert periodic.find_runs(["x"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.find_runs([i % 7 for i in range(200_000)]) == [(0, 200_000, 7)]
    assert periodic.find_runs([bin(i).count("1") % 2 for i in range(1 << 17)]) == []  # no cube
    assert periodic.find_runs(list(b))
    assert time.time() - start < 30


def rows():
    r = random.Random(3)
    out = [(i, " ".join(r.choice("a b c d".split()) if i % 3 else str(r.randrange(999)) for _ in range(r.randrange(0, 120)))) for i in range(200)]
    return out + [(300, None), (301, ""), (302, " \t\x0b\x0c\r\n "), (None, "x " * 50), (5, out[5][1]), (5, out[5][1]), (303, "a b c " * 30), (304, "w " * 5000 + "\x1f" + " v" * 40)]


def wanted(rows):
    out = Counter()
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        h, n = zlib.crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
        runs = periodic.find_runs(w) if n > 200 else brute(w)
        gone = {k for s, m, q in runs for k in range(s + q, s + m)}
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        text = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[(i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(text), sha(kept))] += 1
    return out


def test_query(spark, tmp_path):
    every = rows()
    docs = spark.createDataFrame(every, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "runs", "collapsed", "start", "length", "best")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    run = registry.queries()["op13_periodic_runs"]
    got = run(spark, str(tmp_path)).collect()
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(tuple(r[c] for c in cols) for r in got) == wanted(every)
    assert sum(r.n_runs > 0 for r in got) > 10
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert run(spark, f"{tmp_path}/none").count() == 0
    plain = periodic.runs_and_rest(docs.where("doc_id = 304")).first()
    assert [tuple(r) for r in plain.runs] == [(0, 5000, 1), (5001, 40, 1)] and plain.collapsed == "w \x1f v"
