"""Equal texts score alike, whatever stands beside them."""

import random

import numpy as np

from numera.llm import toxicity


def test_scores_do_not_depend_on_the_batch():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghij", k=r.randrange(2, 9))) for _ in range(400)]
    text = lambda bad: " ".join(r.choices(words, k=r.randrange(1, 120)) + (["vile", "scum"] if bad else []))
    model = toxicity.train([(text(i % 4 == 0), int(i % 4 == 0)) for i in range(80)], epochs=2)
    texts = [text(i % 5 == 0) for i in range(150)]
    whole = model.score(texts)
    model._fresh()
    order = list(range(len(texts)))
    r.shuffle(order)
    out = np.empty(len(texts))
    while order:
        own, order = order[:7], order[7:]
        out[own] = model.score([texts[i] for i in own])
    assert (out == whole).all()
