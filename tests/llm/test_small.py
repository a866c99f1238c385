"""Every operator of the list on small inputs, against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from numera.llm import bpe, embedding, html, lines, packing, pii, simhash, suffixes, topk, toxicity
from numera.llm.common import components

RANKS, VOCAB = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
DOC = "doc_id long, text string"


def texts(n=60, seed=1):
    r = random.Random(seed)
    w = ["the", "of", "naïve", "Ünder", "x1", "don't", "😀", "étude", "token", "a", "mañana", "I", "..."]
    return [" ".join(r.choices(w, k=r.randint(0, 30))) + r.choice(["", "\n", "  ", "\n\n end"]) for _ in range(n)]


def docs(spark, rows):
    """Rows (id, text) with columns whose names clash with those of results."""
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("component_id", "fp", "doc", "at", "k", "s", "e", "n", "score", "label", "length", "spans")}).repartition(3)


ROWS = [(i, t) for i, t in enumerate(texts())] + [(100, None), (101, ""), (102, "   "), (103, "word " * 5000), (104, "a" * 5000)]


def test_components(spark):
    r = random.Random(3)
    e = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    lab = {x: x for p in e for x in p}
    while any(lab[a] != lab[b] for a, b in e):
        for a, b in e:
            lab[a] = lab[b] = min(lab[a], lab[b])
    got = {x.node: x.root for x in components(spark.createDataFrame(e, "src long, dst long")).collect()}
    assert all(got.get(x, x) == c for x, c in lab.items())
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- 1 ------------------------------------------------------------------------------------------------------


def test_embedding(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 16))
    x = [base[i % 40] + 0.02 * r.normal(size=16) for i in range(400)] + [np.zeros(16), base[0] * 3, base[0] * 3]
    rows = [(i, [float(c) for c in np.float32(v)], int(i % 3) if i % 50 else None) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [], 1), (903, [1.0, None], 1), (904, [1.0, 2.0], 1), (905, [2.0, 4.0], 1), (906, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(0)).withColumn("c", F.lit(0))
    good = {i: (lab, np.array(v, float)) for i, v, lab in rows if lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    link = defaultdict(set)
    for a, (la, va) in good.items():
        for b, (lb, vb) in good.items():
            if a < b and la == lb and len(va) == len(vb) and va @ vb / np.sqrt((va @ va) * (vb @ vb)) >= 0.98:
                link[a].add(b)
                link[b].add(a)
    comp = {i: i for i, _, _ in rows}
    for i in sorted(comp):
        todo = [i]
        while todo:
            for j in link[todo.pop()]:
                if comp[j] > comp[i]:
                    comp[j] = comp[i]
                    todo.append(j)
    for tile in (4096, 16):
        out = embedding.links.__defaults__
        monkeypatch.setattr(embedding.links, "__defaults__", (*out[:2], tile, out[3]))
        got = {q.vec_id: (q.n_links, q.component_id, q.kept) for q in embedding.near_duplicates(df).collect()}
        assert got == {i: (len(link[i]), comp[i], comp[i] == i) for i in comp}
    assert embedding.near_duplicates(df.limit(0)).count() == 0


def linked_by_brute_force(rows):
    """(links of every row, component named by its smallest id) by all pairs; rows are (id, vector, label)."""
    x = embedding._unit(np.array([v for _, v, _ in rows]))
    near = x @ x.T >= 0.98
    lab = np.array([y for _, _, y in rows])
    near &= lab[:, None] == lab[None, :]
    np.fill_diagonal(near, False)
    comp = np.arange(len(rows))
    for i in range(len(rows)):
        todo = [i] if comp[i] == i else []
        while todo:
            for j in np.flatnonzero(near[todo.pop()] & (comp > i)).tolist():
                comp[j] = i
                todo.append(j)
    least = {c: min(rows[k][0] for k in np.flatnonzero(comp == c)) for c in set(comp.tolist())}
    return near.sum(axis=1), [least[c] for c in comp.tolist()]


def test_embedding_tables(spark, monkeypatch):
    """Labels large enough to be dealt by tables, one of them with a dense group, and repeated ids."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(500, 32)), np.repeat(r.normal(size=(60, 32)), 5, axis=0) + 0.08 * r.normal(size=(300, 32)), r.normal(size=32) + 0.09 * r.normal(size=(250, 32))])
    rows = [(i if i % 40 else 77, [float(c) for c in np.float32(v)], int(i % 2)) for i, v in enumerate(x)]
    monkeypatch.setattr(embedding.links, "__defaults__", (0.98, 24, 64, 100))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = Counter((q.vec_id, q.n_links, q.component_id) for q in embedding.near_duplicates(df).collect())
    n, comp = linked_by_brute_force(rows)
    assert n.sum() > 1000 and got == Counter((i, int(k), c) for (i, _, _), k, c in zip(rows, n, comp))
    doubles = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1e-9], 0), (3, [1.0, 0.2031], 0)], "vec_id long, embedding array<double>, label int")
    assert [q.n_links for q in embedding.near_duplicates(doubles).orderBy("vec_id").collect()] == [1, 1, 0]


def test_few_pairs_are_compared():
    """Over three sizes of clustered vectors the pairs that share a cell stay few, and their share falls."""
    shares = []
    for n in (4_000, 16_000, 64_000):
        r = np.random.default_rng(1)
        x = embedding._unit(np.repeat(r.normal(size=(n // 4, 64)), 4, axis=0) + 0.1 * r.normal(size=(n, 64)))
        g, tables = embedding.shape(n, 64, 0.98, whole=1000)
        at = embedding.cells(x, g, tables, 0.98)
        pairs = sum(int((c * (c - 1) // 2).sum()) for k in range(tables) for c in [np.unique(at[:, k], return_counts=True)[1]])
        shares.append(pairs / (n * (n - 1) / 2))
        # linked pairs share a cell
        i = np.arange(0, n, 4)
        linked = np.einsum("ij,ij->i", x[i], x[i + 1]) >= 0.98
        assert (at[i[linked]] == at[i[linked] + 1]).any(axis=1).all()
    print("share of pairs compared:", shares)
    assert max(shares) < 0.05 and shares[0] > shares[1] > shares[2]


def test_no_pair_is_missed_by_the_counts():
    r = np.random.default_rng(0)
    x = embedding._unit(r.normal(size=(300, 32)) + np.repeat(r.normal(size=(30, 32)) * 6, 10, axis=0))
    every = np.arange(len(x))
    found = {(a, b) for i, j in embedding.collide(x, every, every, 0.98, 24) for a, b in zip(i.tolist(), j.tolist())}
    s = x @ x.T
    assert found == {(a, b) for a, b in zip(*map(list, np.nonzero(s >= 0.98))) if a != b}


def test_labels_of_the_large_run_are_not_dealt(spark):
    """615,384 vectors of ten labels are 61,538 a label: compared as they are, a vector in as many copies as there are tiles."""
    assert embedding.shape(61_538, 64, 0.98) == (0, 1)
    assert -(-61_538 // embedding.TILE) <= 2
    r = np.random.default_rng(3)
    x = r.normal(size=(17_000, 24))
    x[16_000:] = x[:1000] + 0.05 * r.normal(size=(1000, 24))
    df = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(np.float32(x))], "vec_id long, embedding array<float>, label int")
    got = {q.vec_id: (q.n_links, q.component_id) for q in embedding.near_duplicates(df).collect()}
    u = embedding._unit(np.float32(x).astype(float))
    near = [np.flatnonzero(row >= 0.98) for b in range(0, len(u), 1000) for row in u[b : b + 1000] @ u.T]
    assert all(got[i][0] == len(k) - 1 and got[i][1] == k[0] for i, k in enumerate(near) if len(k) < 3)
    assert sum(len(k) == 2 for k in near) > 1500


def test_counts_lose_no_pair_and_leave_few():
    """Against brute force in several dimensions and thresholds, over pairs of tiles and a tile by itself, with a group so dense that blocks are told at once."""
    r = np.random.default_rng(2)
    for dim, threshold in ((2, 0.98), (3, 0.999), (24, 0.9), (64, 0.98), (64, 0.6), (200, 0.98), (64, 1 - 1e-9)):
        x = np.concatenate([r.normal(size=(700, dim)), r.normal(size=dim) + 0.12 * r.normal(size=(500, dim)), np.eye(dim)[:2]])
        x = embedding._unit(np.concatenate([x, x[:300] + 0.15 * r.normal(size=(300, dim)), x[5:9] * 3]))
        at = r.permutation(len(x))
        s = x @ x.T
        sure, open_ = s >= threshold + 1e-9, s >= threshold - 1e-9
        for left, right in ((at, at), (at[:333], at[333:])):
            found = [p for i, j in embedding.collide(x, left, right, threshold, 24) for p in zip(i.tolist(), j.tolist())]
            assert len(found) == len(set(found))
            inside = np.zeros(s.shape, bool)
            inside[np.ix_(left, right)] = True
            np.fill_diagonal(inside, False)
            got = np.zeros(s.shape, bool)
            got[tuple(np.array(found).reshape(-1, 2).T)] = True
            assert not (got & ~(open_ & inside)).any() and not (sure & inside & ~got).any()
    seen = []
    x, every = embedding._unit(r.normal(size=(3000, 64))), np.arange(3000)
    assert not [1 for _ in embedding.collide(x, every[:1500], every[1500:], 0.98, 24, seen)]
    # half-widths for four windows left 52 % of these pairs open after the six projections that were counted for all
    assert sum(v for _, v in seen) < 2e-4 * 1500**2


# --- 2, 5 ---------------------------------------------------------------------------------------------------


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(3000)) and h.get(b"other") == -1 and h.n == len(keys)
    assert bpe.PerfectHash([]).get(b"x") == -1


def test_bpe(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = {i: enc.encode_ordinary(t or "") for i, t in ROWS}
    df = docs(spark, ROWS)
    ids = bpe.encode(df, RANKS, P.PATTERN)
    assert {r.doc_id: r.ids for r in ids.collect()} == want
    assert {r.doc_id: bytes(r.bytes).decode() for r in bpe.decode(ids, RANKS, P.PATTERN).collect()} == {i: t or "" for i, t in ROWS}
    for r in bpe.encode_digests(df, RANKS, P.PATTERN).collect():
        assert (r.n_tokens, r.ids_sha256) == (len(want[r.doc_id]), hashlib.sha256(" ".join(map(str, want[r.doc_id])).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((dict(ROWS)[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_bpe_on_odd_white_space(monkeypatch):
    tok = bpe.Tokenizer(bpe.read_ranks(RANKS), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    monkeypatch.setattr(bpe, "MEMO", 50)
    r = random.Random(9)
    for _ in range(4000):
        s = "".join(r.choices(" \n\t\r\x0b\x1c\xa0 ab1!'é<|endoftext|>", k=r.randint(0, 24)))
        assert tok.encode(s) == enc.encode_ordinary(s), repr(s)
        assert tok.decode(tok.encode(s)) == s.encode()


def test_packing(spark):
    tok = Tokenizer.from_file(VOCAB)
    rows = [*ROWS, (7, ROWS[7][1]), (None, "x")]
    out = packing.pack(docs(spark, rows), VOCAB, bucket=10).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[(i, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(docs(spark, []), VOCAB).count() == 0


def test_packing_of_one_id(spark):
    """A third of all rows repeat one row: every one has its own place, and no task numbers them all."""
    rows = [(5, "one text under one id")] * 400 + [(10 + i, f"text {i} " * (i % 7)) for i in range(800)]
    out = packing.pack(docs(spark, rows), VOCAB, bucket=100).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in rows) and len({(r.sequence_id, r.offset) for r in out}) == len(rows)


def test_plan_reaches_the_bound():
    r = random.Random(2)
    for counts in ({1000: 7, 1048: 7}, {512: 8, 1024: 3}, {2047: 5, 1: 5}, {700: 3, 648: 3}, {1025: 10}, Counter(r.randint(1, 2048) for _ in range(5000)), Counter(min(2048, int(r.lognormvariate(5, 1)) + 1) for _ in range(20000))):
        p = packing.plan(dict(counts))
        used = Counter()
        for lengths, m in p.patterns:
            assert sum(lengths) <= 2048
            for n in lengths:
                used[n] += m
        assert used == Counter(counts)
        bound = max(-(-sum(n * c for n, c in counts.items()) // 2048), sum(c for n, c in counts.items() if n > 1024))
        assert p.sequences <= bound * 1.01 + 1
    # gaps that only pairs or triples fill
    assert packing.plan({1500: 4, 300: 4, 248: 4}).sequences == packing.plan({1400: 5, 300: 5, 200: 5, 148: 5}).sequences - 1 == 4
    # the documents of sf0.01 and like them: as many sequences as their tokens need at least
    counts = Counter(min(2048, int(r.lognormvariate(6, 1.2)) + 1) for _ in range(3000))
    assert packing.plan(dict(counts)).sequences == -(-sum(n * c for n, c in counts.items()) // 2048)


def test_sums_index():
    """Every filling is one the counts allow, of as few lengths as any has."""
    r = random.Random(8)
    for _ in range(300):
        avail = np.zeros(41, np.int64)
        for _ in range(r.randint(1, 8)):
            avail[r.randint(1, 40)] += r.randint(1, 2)
        sums = packing.Sums(avail)
        for gap in range(1, 41):
            had = [n for n in range(41) for _ in range(avail[n])]
            sizes = [k for k in (1, 2, 3) if any(sum(c) == gap for c in combinations(had, k))]
            got = sums.filling(gap)
            assert (got is None) == (not sizes)
            if got:
                assert sum(got) == gap and len(got) == sizes[0] and not Counter(got) - Counter(had)
                if r.random() < 0.3:
                    for n in got:
                        avail[n] -= 1


def test_encoder_parts_units(monkeypatch):
    """Units encoded together, remembered or forgotten give the ids of whole texts."""
    tok = Tokenizer.from_file(VOCAB)
    encoder = packing._encoder(open(VOCAB, "rb").read())
    r = random.Random(4)
    every = [None, "", " ", "\n", "a", " a", "a ", "a  b", "x" * 500 + " " + "y " * 3, "word, word. Word? it's he'll. don' x', 9. 9, a.b, é,", "<|endoftext|> 中文 é"] + ["".join(r.choices(" \n\t\r\x0b\x1c\xa0 ab1!.,'é中<|endoftext|>", k=r.randint(0, 60))) for _ in range(1500)]
    every += ["".join(r.choices("   \nab1!.,'é中", k=r.randint(0, 60))).replace("  ", " ").strip() for _ in range(800)]
    every += ["".join(r.choices([" ", "\n", "a", "b1", "é", "<|endoftext|>"], k=r.randint(0, 12))) for _ in range(400)]
    assert encoder.encode(pa.array(["x <|endoftext|> y"]))[0].tolist() == [87, 220, 50256, 331, 0]
    encoder.forget()
    monkeypatch.setattr(packing, "MEMO", 50)
    for _ in range(2):
        for k in range(0, len(every), 400):
            ids, at = encoder.encode(pa.array(every[k : k + 400], pa.string()))
            assert len(at) == len(every[k : k + 400]) + 1
            for t, a, b in zip(every[k : k + 400], at[:-1], at[1:]):
                assert ids[a:b].tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 0], repr(t)


# --- 3 ------------------------------------------------------------------------------------------------------


def test_html_held_out():
    model = html.train()
    pages = html.labelled_pages(150, seed=4321)
    got = html.extract_texts([s for s, _ in pages], model)
    assert sum(a == "\n".join(g) for a, (_, g) in zip(got, pages)) >= 0.97 * len(pages)


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    parent, depth = np.array([-1, 0, 0, 1, 1, 3]), np.array([0, 1, 1, 2, 2, 3])
    unary, pair = r.normal(size=(6, 2)), r.normal(size=(2, 2))
    p, joint = html.marginals(parent, depth, unary, pair)
    weights = {}
    for code in range(64):
        y = [(code >> i) & 1 for i in range(6)]
        weights[tuple(y)] = np.exp(sum(unary[i, y[i]] for i in range(6)) + sum(pair[y[parent[i]], y[i]] for i in range(1, 6)))
    z = sum(weights.values())
    for i in range(6):
        assert abs(p[i] - sum(w for y, w in weights.items() if y[i]) / z) < 1e-9
    assert abs(joint[3, 1, 0] - sum(w for y, w in weights.items() if y[1] == 1 and y[3] == 0) / z) < 1e-9


def test_html_pages(spark):
    page = '<html><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; B</h1><p>First  part<br>goes on &lt;here&gt;<p><b>Second<script>x("</p>")</script> part</article><div class="comments"><p>I disagree with all of this.</p></div><footer>c</footer>'
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<" * 3000), (5, "u", "<p>" * 2000 + "deep"), (6, "u", '<a href="' * 500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = sorted((r.page_id, r.text, r.n_chars) for r in html.extract(df).collect())
    text = "A & B\nFirst part goes on <here>\nSecond part"
    assert got[0] == got[1] == (1, text, len(text))
    assert got[2] == (2, "", 0) and got[3] == (3, "", 0) and len(got) == 7
    assert html.extract(df.limit(0)).count() == 0


# --- 4 ------------------------------------------------------------------------------------------------------


def test_html_takes_time_in_proportion():
    """Tags, quotes, comments and elements that never close: two megabytes of each take a few seconds at most."""
    for x in ("<a " * 700_000, '<a href="' * 220_000, '<a ">" ' * 300_000 + "'", "<" * 2_000_000, "<!--" * 500_000, "<script>" + "</script " * 220_000, "<div>" * 200_000 + "</p>" * 250_000, "<ul><li>" * 250_000):
        start = time.process_time()
        html.parse(x)
        assert time.process_time() - start < 12, x[:20]
    page = html.parse("a<b <p>x</p> <!-- <p> --><q title='>'>y</q><p class=\">z")
    assert [("".join(t).split(), page.tag[k]) for k, t in page.blocks] == [(["ax"], "html"), (["y"], "html"), (["z"], "p")]


def brute_lines(rows, t=0.8):
    every = sorted((d, i, frozenset(x.encode().lower().split())) for d, x in rows if d is not None and x is not None for i, x in enumerate(x.split("\n")))
    gone = set()
    for k, (d, i, s) in enumerate(every):
        if s and any(len(s & q) >= t * len(s | q) - 1e-9 for _, _, q in every[:k] if q):
            gone.add((d, i))
    return {d: x if x is None else "\n".join(y for i, y in enumerate(x.split("\n")) if (d, i) not in gone) for d, x in rows}


@pytest.mark.parametrize("small", [{}, {"WINDOW": 2, "NAMED": 1, "PART": 100, "HELD": 50}, {"WINDOW": 1, "SEEN": 3, "PACK": 40}, {"MOST": 30, "SEEN": 2, "PACK": 20}])
def test_lines(spark, monkeypatch, small):
    for k, v in small.items():
        monkeypatch.setattr(lines, k, v)
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    base = [" ".join(r.choices(vocab, k=r.randint(1, 25))) for _ in range(40)] + [" ".join(f"q{i}" for i in range(150))]

    def near(x):
        w = x.split()
        for _ in range(r.randint(0, 3)):
            w.insert(r.randrange(len(w) + 1), r.choice(vocab)) if r.random() < 0.5 else len(w) > 1 and w.pop(r.randrange(len(w)))
        return " ".join(w)

    rows = [(i, "\n".join(near(r.choice(base)) if r.random() < 0.8 else " ".join(r.choices(vocab, k=r.randint(0, 12))) for _ in range(r.randint(1, 8)))) for i in range(120)]
    rows += [(900, None), (901, ""), (902, "\n\n a\n"), (903, "Z" * 70_000 + " É b\x0bc d e " + "y" * 60), (904, "z" * 70_000 + "\té B c D e " + "Y" * 60)]
    rows += [(905, "  p q r s t u v"), (899, "\n"), (906, "v u t S r q p \n\nv u t s r q p o")]
    got = {q.doc_id: q.text for q in lines.dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_words_of_lines():
    """Words and their hashes do not depend on how texts are parted."""
    r = random.Random(9)
    alphabet = "abC \n\té中"
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 1, 5, 40, 300]))) for _ in range(200)] + ["x" * 200_000 + " Ab\nab " + "Y" * 47 + " " + "y" * 49, "ab " * 60_000]
    for part in (1, 64, 1 << 18):
        hashed: dict = {}
        for base, x, start, stop, line, starts, own in lines._parts(pa.array(texts), part):
            text = np.searchsorted(own, starts[line], side="right") - 1
            number = line - np.searchsorted(starts, own)[text]
            for t, k, h, a, b in zip((base + text).tolist(), number.tolist(), lines._hashes(x, start, stop).tolist(), start.tolist(), stop.tolist()):
                hashed.setdefault((t, k), []).append((h, bytes(x[a:b]).lower()))
        want = {(t, k): y.encode().lower().split() for t, x in enumerate(texts) for k, y in enumerate(x.split("\n")) if y.split()}
        assert {q: [w for _, w in ws] for q, ws in hashed.items()} == want
        pairs = {x for ws in hashed.values() for x in ws}
        assert len(pairs) == len({h for h, _ in pairs}) == len({w for _, w in pairs})


@pytest.mark.parametrize("window, most", [(16, 1 << 22), (1024, 1 << 22), (1024, 200)])
def test_one_family_of_lines(spark, monkeypatch, window, most):
    """Many near copies of one line, each under the same words, and lines that only just miss it."""
    monkeypatch.setattr(lines, "WINDOW", window)
    monkeypatch.setattr(lines, "MOST", most)
    monkeypatch.setattr(lines, "PACK", min(most, 1 << 19) // 4)
    monkeypatch.setattr(lines, "NAMED", 1)
    r = random.Random(3)
    first = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(600):
        w = list(first)
        for _ in range(r.choice([0, 1, 2, 3, 4, 5, 6, 9])):
            w[r.randrange(40)] = f"v{r.randrange(50)}"
        rows.append((i, " ".join(w)))
    got = {q.doc_id: q.text for q in lines.dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_lines_keep_what_they_cannot_order(spark):
    rows = [(None, "one two three four five six"), (1, "one two three four five six"), (2, "a b c d"), (2, "a b c d")]
    got = sorted((repr(q.doc_id), q.text) for q in lines.dedup(docs(spark, rows)).collect())
    assert got == sorted((repr(d), t) for d, t in rows)
    assert lines.dedup(docs(spark, [])).count() == 0
    kept = lines.strip(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == 4


# --- 6 ------------------------------------------------------------------------------------------------------


def test_top_k(spark, monkeypatch):
    r = np.random.default_rng(2)
    x = np.float32(np.round(r.normal(size=(230, 8)), 1))
    x[50:120] = x[50]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(300, None), (350, [float("nan")] * 8), (400, []), (450, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("tile", F.lit(1))
    v = np.floor(256 * x.astype(float)).astype(np.int64)
    want = []
    for q in range(0, 230, 50):
        s = v @ v[q]
        for k, i in enumerate([i for i in np.lexsort((np.arange(230), -s)) if i != q][:5]):
            want.append((q, k + 1, int(i), int(s[i])))
    for tile in (8192, 40):
        monkeypatch.setattr(topk, "TILE", tile)
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect())) == want
    # a product that does not fit a long takes its own pair out, and no other
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (50, [1.0, 0.0]), (51, [2.0, -1e5]), (52, [0.5, 1e12])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(huge, F.col("vec_id") % 50 == 0).collect()))
    assert got == [(50, 1, 51, 256 * 512), (50, 2, 52, 256 * 128)]
    few = df.where("vec_id in (0, 3, 7)")
    assert topk.top_k(few, F.col("vec_id") % 50 == 0).count() == 2
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# --- 7 ------------------------------------------------------------------------------------------------------


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_base_spans():
    r = random.Random(2)
    for _ in range(8000):
        t = "".join(r.choices("0123456789.@a-+ ()_%B5é", k=40))
        assert brute_pii(t) == pii.base_spans(t), t
    for t in ("9" * 100_000, "a" * 100_000 + "@", "@" * 50_000, "1." * 50_000, "+1" * 50_000, "0" * 6000 + ".1.1.1"):
        pii.base_spans(t)


def test_field_held_out_and_exact_pruning():
    field = pii.Field(*pii.train())
    right = total = 0
    for words, labels in pii.labelled_rows(200, seed=99):
        em = np.stack([field.w[list(pii.shape(w))].sum(axis=0) for w in words])[None]
        path = field.viterbi(em)[0]
        right += sum(pii.LABELS[p] == y for p, y in zip(path, labels))
        total += len(labels)
        text = " ".join(words)
        assert sorted(field._runs(text, [m.span() for m in pii.WORD.finditer(text)], path)) == sorted(field.spans([text])[0])
    assert right / total > 0.98


def test_pii(spark):
    text = 'Mail 34@mail7.example.com or +1 (017) 555-7713, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 10.0.0.1'
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, "nothing here"), (5, "9" * 200_000)]
    got = {r.doc_id: [(x.kind, x.start, x.stop) for x in r.spans] for r in pii.find(docs(spark, rows)).collect()}
    assert {k for k, _, _ in got[1]} == {"email", "phone", "secret", "ip"} and got[2] == got[3] == got[4] == []
    clean = {r.doc_id: r.text for r in pii.redact(docs(spark, rows)).collect()}
    assert clean[1] == 'Mail [EMAIL] or [PHONE], token = "[SECRET]" [IP]' and clean[2] is None and clean[4] == "nothing here"
    assert pii.find(docs(spark, [])).count() == 0


# --- 8 ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [8192, 10])
def test_suffixes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "FLUSH", 50)
    monkeypatch.setattr(suffixes, "CHUNK", 1 << 11)
    r = random.Random(3)
    noise = lambda n: "".join(r.choices("abcdef é", k=n))
    shared = [noise(r.choice([150, 199, 200, 201, 260, 700])) for _ in range(25)]
    rows = []
    for i in range(200):
        k = r.random()
        if k < 0.1:
            t = noise(r.randint(0, 300))
        elif k < 0.15:
            t = "ab" * r.randint(50, 400)
        elif k < 0.2:
            t = "x" * r.randint(150, 3000)
        else:
            t = "".join(r.choice([noise(r.randint(0, 120)), r.choice(shared), r.choice(shared)[r.randint(0, 60) :]]) for _ in range(r.randint(1, 6)))
        rows.append((i, t))
    rows += [(i, rows[i][1]) for i in range(5)] + [(1000, None), (1001, ""), (None, shared[0]), (7, "other " + shared[1])] + [(2000 + i, noise(30) + shared[5] + noise(40)) for i in range(60)]
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    want = Counter()
    for (d, _), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        spans = sum(1 for i in range(len(gone)) if gone[i] and (not i or not gone[i - 1]))
        want[(d, len(b), sum(gone), spans, bytes(x for x, k in zip(b, gone) if not k))] += 1
    got = Counter((q.doc_id, q.n_bytes, q.n_removed, q.n_spans, bytes(q.kept)) for q in suffixes.remove_repeats(docs(spark, rows)).collect())
    assert got == want
    assert suffixes.remove_repeats(docs(spark, [])).count() == 0


def test_multikey_order():
    r = np.random.default_rng(4)
    w = r.integers(0, 3, (500, 5)).astype(np.uint64)
    order, same = suffixes.multikey_order(w)
    rows = [tuple(x) for x in w[order]]
    assert rows == sorted(map(tuple, w))
    for a, b, s in zip(rows, rows[1:], same[1:]):
        assert s == next((i for i in range(5) if a[i] != b[i]), 5)


# --- 9 ------------------------------------------------------------------------------------------------------


def test_gradients():
    net = toxicity.Network(1)
    r = np.random.default_rng(0)
    x = r.normal(size=(6, 4, toxicity.DIM)).astype(np.float64)
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 5])[None, :]).astype(np.float64)
    y = np.array([1.0, 0, 1, 0])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g, dx, _ = net.step(x, mask, y)
    for k in ("wf", "ub", "nf", "v", "a", "o", "cb", "ae", "oe"):
        at = tuple(r.integers(0, s) for s in net.p[k].shape)
        old, h, loss = net.p[k][at], 1e-4, []
        for d in (h, -h):
            net.p[k][at] = old + d
            loss.append(net.step(x, mask, y)[2])
        net.p[k][at] = old
        assert abs((loss[0] - loss[1]) / (2 * h) - g[k][at]) < 1e-3


def test_toxicity(spark):
    r = random.Random(1)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(240):
        y = i % 4 == 0
        w = r.choices(vocab, k=r.randint(5, 150))
        if y:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["baddest", "badly", "badness"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    extra = [(500, None), (501, ""), (502, "w1 " * 4000)]
    df = docs(spark, rows + extra)
    lab = spark.createDataFrame([*labels, (0, None), (None, 1), (7, 5)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab)
    got = {x.doc_id: x.score for x in toxicity.score(df, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= toxicity.CUT) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[500] == got[501] < 0.5 and all(0 <= s <= 1 for s in got.values())
    kept = {x.doc_id for x in toxicity.clean(df, model).collect()}
    assert kept == {i for i, s in got.items() if s < toxicity.CUT}
    assert toxicity.fit(df.limit(0), lab).score(["x"])[0] >= 0


# --- 10 -----------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, monkeypatch):
    assert all(simhash.fingerprint(t) == slow_fingerprint(t) for _, t in ROWS if t is None or len(t) < 10_000)
    r = random.Random(8)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        f = r.choice(fps)
        for _ in range(r.randint(0, 2)):
            f ^= 1 << r.randrange(64)
        fps.append(f)
    uniq = sorted(set(fps))
    df = spark.createDataFrame([(np.uint64(f).view(np.int64).item(), i) for i, f in enumerate(uniq)], "fp long, rep long")
    lab = list(range(len(uniq)))
    for i in range(len(uniq)):
        for j in range(i):
            if (uniq[i] ^ uniq[j]).bit_count() <= 2 and lab[i] != lab[j]:
                a, b = sorted((lab[i], lab[j]))
                lab = [a if x == b else x for x in lab]
    for large in (4096, 4):
        monkeypatch.setattr(simhash, "LARGE_RUN", large)
        got = {x.node: x.root for x in components(simhash.links(df)).collect()}
        assert [got.get(i, i) for i in range(len(uniq))] == lab


def test_simhash_documents(spark):
    rows = [*ROWS, (200, ROWS[3][1]), (200, ROWS[3][1]), (None, "x y z")]
    got = {x.doc_id: (x.fp, x.component_id) for x in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got[200][1] == got[3][1] and got[100][1] == got[101][1] == got[102][1] and got[100][0] == 0 and got[None][1] is None
    kept = simhash.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert {x.doc_id for x in kept.collect()} == {i for i, (_, c) in got.items() if i is None or i == c}
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
