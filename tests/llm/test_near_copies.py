"""The near-duplicate stage of the pipeline against brute force: edited copies, repeated ids, nulls."""

import random

import corpus_pipeline
from numera.llm import shingles


def five_words(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Component of each row, named by its smallest id."""
    sets = [five_words(t) for _, t in rows]
    lab = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if lab[i] != lab[j] and (a == b or (a and b and 5 * len(a & b) >= 4 * len(a | b))):
                x, y = sorted((lab[i], lab[j]))
                lab = [x if q == y else q for q in lab]
    low = {c: min(rows[i][0] for i in range(len(rows)) if lab[i] == c) for c in set(lab)}
    return [low[c] for c in lab]


def edited(r, words, share):
    w = list(words)
    for i in r.sample(range(len(w)), max(1, int(share * len(w)))):
        w[i] = f"z{r.randrange(10**6)}"
    return " ".join(w)


def test_edited_copies_leave_the_pipeline(spark):
    r = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    rows = []
    for _ in range(60):
        base = r.choices(vocab, k=r.randint(64, 660))
        rows.append(" ".join(base))
        rows += [edited(r, base, s) for s in (0, 0.01, 0.02, 0.03, 0.05)]
    core = r.choices(vocab, k=300)
    rows += [edited(r, core, r.choice([0.01, 0.015, 0.02])) for _ in range(80)]
    rows += ["", " ", "a b c", "A  b c", "a b d", "one two three four five six seven eight nine", "one two three four five six seven eight nine ten", "x " * 3000]
    r.shuffle(rows)
    rows = list(enumerate(rows))
    rows += [(3, "an other text under an id that another row has too"), (9, rows[50][1])]
    want = brute(rows)
    df = spark.createDataFrame([*rows, (None, rows[0][1]), (7000, None)], "doc_id long, text string").repartition(3)
    empty = next(c for c, (_, t) in zip(want, rows) if not t.split())
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    expect = [(i, t) for (i, t), c in zip(rows, want) if i == c] + [(None, rows[0][1])]
    assert empty < 7000 and sorted(map(tuple, kept.collect()), key=repr) == sorted(expect, key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, df.limit(0), "").count() == 0


def test_no_pair_over_the_threshold_is_missed(spark):
    r = random.Random(6)
    vocab = [f"v{i}" for i in range(3000)]
    found = total = 0
    for _ in range(300):
        base = r.choices(vocab, k=r.randint(64, 660))
        a, b = (shingles.shingle_set(t) for t in (" ".join(base), edited(r, base, r.choice([0.005, 0.01, 0.02]))))
        if 5 * len(set(a.tolist()) & set(b.tolist())) < 4 * len(set(a.tolist()) | set(b.tolist())):
            continue
        total += 1
        (f1, f2, k), (g1, g2, q) = shingles.sketch(a), shingles.sketch(b)
        found += bool((k == q).any()) and (f1 ^ g1).bit_count() + (f2 ^ g2).bit_count() <= shingles.RADIUS
    assert total > 200 and found == total


def test_one_hot_key(spark, monkeypatch):
    """Documents that share a long passage, and so band keys, fall apart into tiles with the result of one tile."""
    r = random.Random(9)
    vocab = [f"v{i}" for i in range(500)]
    shared = " ".join(r.choices(vocab, k=90))
    rows = []
    for _ in range(150):
        own = r.choices(vocab, k=r.choice([10, 60, 90]))
        rows.append(shared + " " + " ".join(own))
        rows += [shared + " " + edited(r, own, 0.03) for _ in range(3)]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {}
    for tile in (1 << 30, 32):
        monkeypatch.setattr(shingles, "TILE", tile)
        found[tile] = {x.doc_id: x.component_id for x in shingles.near_duplicates(df).collect()}
    assert found[32] == found[1 << 30] == {i: c for (i, _), c in zip(rows, brute(rows))}
