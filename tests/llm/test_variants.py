"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from numera.llm import registry, variants


def near(a, b):
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows):
    n = Counter()
    for i, t in rows:
        for x in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            x = "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
            h = zlib.crc32(f"{'' if i is None else i}:{x}".encode())
            if h % 97 == 0:
                x = x[: h % len(x)] + x[h % len(x) + 1 :]
            if len(x) >= 5:
                n[x] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    of = {}
    for w in n:
        found = [v for v in n if near(w, v)]
        best = min(found, key=lambda v: (-n[v], v), default=None)
        of[w] = (best if best and n[best] >= 2 * n[w] else None, len(found))
    out = set()
    for w, (form, k) in of.items():
        root = w
        while of[root][0]:
            root = of[root][0]
        out.add((w, form, root, n[w], k, n[form] if form else None))
    return out


def made(seed=4):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéüß") for _ in range(r.randrange(4, 9))) for _ in range(25)]
    words = []
    for w in base:
        for _ in range(r.randrange(1, 60)):
            x = list(w)
            for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
                k = r.randrange(len(x))
                x[k : k + r.choice([0, 1])] = r.choice([[], ["a"], ["É"], ["x", "x"]])
                x = x or ["a"]
            words += ["".join(x)] * r.randrange(1, 4)
    r.shuffle(words)
    rows = [(i, " ".join(words[i::60]).replace("b", "B")) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " - 1 × 2"), (None, "straße straße straße Straße"), (5, rows[5][1]), (5, rows[5][1]), (103, "chain " * 3 + "chains " * 6 + "chainss " * 12 + "chainsss " * 25), (104, "y" * 3000 + " " + "y" * 3001 + " ")] + [(104, "y" * 3000 + " " + "y" * 3001)] * 4


@pytest.mark.parametrize("chunk", [64, 1 << 21])
def test_neighbours_are_whole_and_distinct(monkeypatch, chunk):
    monkeypatch.setattr(variants, "CHUNK", chunk)
    r = random.Random(1)
    words = list({"".join(r.choice("abcàé") for _ in range(r.randrange(1, 9))) for _ in range(300)})
    want = set()
    for w in words:
        for k in range(len(w) + 1):
            want |= {(w[:k] + c + w[k:], w) for c in "abcàé"}
            if k < len(w):
                want |= {(w[:k] + w[k + 1 :], w)} | {(w[:k] + c + w[k + 1 :], w) for c in "abcàé" if c != w[k]}
    got = Counter(variants.neighbours(words, list("abcàé")))
    assert set(got) == want and max(got.values()) == 1


def test_forms(spark, monkeypatch):
    rows = made()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "run", "word", "n", "form", "near")}).repartition(3)
    want = brute(rows)
    assert len(want) > 30 and any(f and f != r for _, f, r, *_ in want)
    for bits in (27, 7):  # a table of few bits lets nearly all neighbours through
        monkeypatch.setattr(variants, "BITS", bits)
        got = variants.spelling_forms(docs, rewrite=variants.damaged)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {tuple(r) for r in got.collect()} == want
    assert variants.spelling_forms(docs.limit(0)).count() == 0
    plain = {r.word: r.n for r in variants.vocabulary(docs).collect()}
    assert plain["straße"] == 4


def test_query(spark, tmp_path):
    rows = made(9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in registry.queries()["op11_spelling_variants"](spark, str(tmp_path)).collect()} == brute(rows)


def test_vocabulary_is_not_broadcast(spark, monkeypatch):
    """Small files of words are not taken for small tables: no join goes by way of the driver."""
    plans = []
    kept = variants.cut
    monkeypatch.setattr(variants, "cut", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, name))
    docs = spark.createDataFrame(made(), "doc_id long, text string")
    out = variants.spelling_forms(docs)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
