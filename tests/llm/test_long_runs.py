"""The toxicity network reads whole runs, however long and however glued."""

import random

from numera.llm import toxicity


def test_toxic_words_inside_long_runs():
    r = random.Random(3)
    vocab = ["".join(r.choices("mnoprtuv", k=r.randint(4, 8))) for _ in range(300)]
    bad = ["baddest", "badly", "badness"]
    rows = []
    for i in range(400):
        w = r.choices(vocab, k=r.randint(20, 80))
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        if i % 5 == 0:
            w.append("/".join(r.choices(vocab, k=6)))
        rows.append((" ".join(w), int(i % 4 == 0)))
    model = toxicity.train(rows)
    for glue in ("", "/", ","):
        clean, toxic = [], []
        for _ in range(40):
            w = r.choices(vocab, k=30)
            clean.append(glue.join(w))
            toxic.append(glue.join([*w[:15], *bad, *w[15:]]))
        a, b = model.score(clean), model.score(toxic)
        assert (a < toxicity.CUT).mean() >= 0.9, glue
        # before, only the ends of a run were read: equal scores, or nearly
        assert (b > 3 * a).mean() >= 0.9, glue
        # letters glued to letters leave no word whole, so not all of these reach the cut
        assert not glue or (b >= toxicity.CUT).mean() >= 0.9, glue


def test_every_four_gram_of_a_run_enters():
    r = random.Random(5)
    for n in (19, 20, 21, 22, 23, 31, 32, 33, 44, 45, 500):
        w = "".join(r.choices("abcdefghijklmnop", k=n))
        have = {g for x in toxicity.words_of(w) for g in toxicity.grams(x)}
        assert {w[i : i + 4] for i in range(n - 3)} <= have, n
        assert w in toxicity.words_of(w)
    assert toxicity.words_of(None) == [] and toxicity.words_of("a b") == ["a", "b"]
    assert {"alpha", "beta", "gamma"} <= set(toxicity.words_of("alpha/beta-gamma/delta/epsilon"))


def test_gram_table_finds_what_a_dictionary_finds():
    r = random.Random(1)
    words = ["", "a", "ab", "abc", "abcd", "é中x$^", "y" * 5000] + ["".join(r.choices("abcdé中", k=r.randint(0, 40))) for _ in range(1500)]
    names = list(dict.fromkeys(g for w in words[::2] for g in toxicity.grams(w)))
    table, at = toxicity.GramTable(names), {g: i for i, g in enumerate(names)}
    h, of, parts = toxicity.gram_hashes(words)
    row = table.find(h)
    bounds = [0, *parts.cumsum().tolist()]
    for i, w in enumerate(words):
        assert sorted(row[bounds[i] : bounds[i + 1]].tolist()) == sorted(at.get(g, -1) for g in toxicity.grams(w))
    assert (of[:-1] <= of[1:]).all() and (toxicity.GramTable([]).find(h) < 0).all()
