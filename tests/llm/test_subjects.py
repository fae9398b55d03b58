"""Subjects: held-out accuracy on made-up documents, sentences, gradients."""

import random

import numpy as np
import pytest

from tessera.llm import subjects as S


def test_sentences():
    assert S.sentences("See no. 51374. A reader came!\n\nNext part") == [["see", "no"], ["a", "reader", "came"], ["next", "part"]]
    assert S.sentences("如果缺少油泵，就查。先看") == [["如果", "果缺", "缺少", "少油", "油泵", "就查"], ["先看"]]
    assert S.sentences(None) == S.sentences("") == [[]] or S.sentences(None) == []
    assert sum(map(len, S.sentences("w " * 1000))) == 1000


def test_gradient_equals_differences():
    bag = S.Bag([[["aa", "bb"], ["cc"]], [["bb"]]])
    y = np.array([[1, 0], [0, 1]], np.float32)
    model = {k: v.astype(np.float64) for k, v in S.fresh(2).items()}

    def loss():
        p = S.scores(model, bag)
        t = y[bag.owner]
        return -(t * np.log(p) + (1 - t) * np.log(1 - p)).sum()

    g, n = S.gradient(model, bag, y)
    assert n == 3
    for k, at in (("out", (3, 1)), ("bias", (0,)), ("table", (S.pieces("bb")[0], 2))):
        keep, eps = model[k][at], 1e-4
        model[k][at] = keep + eps
        hi = loss()
        model[k][at] = keep - eps
        lo = loss()
        model[k][at] = keep
        assert g[k][at] == pytest.approx((hi - lo) / (2 * eps), rel=2e-2, abs=1e-4)


def test_learns_subjects(spark):
    rng = random.Random(7)
    themes = {"sea": ["harbour", "anchor", "sailor", "tide", "vessel"], "sky": ["cloud", "pilot", "runway", "wing", "altitude"], "farm": ["barley", "cattle", "plough", "meadow", "orchard"]}
    plain = ["The note was left on the table in the morning.", "Two people read it and went home.", "Nothing else was said about the matter.", "It took some time to find the page."]
    rows, labels, truth = [], [], set()
    for i in range(500):
        mine = rng.sample(sorted(themes), rng.randrange(1, 3))
        parts = [rng.choice(plain) for _ in range(rng.randrange(0, 5))]
        for s in mine:
            parts += [f"The {a} met the {b} near a {c} today." for a, b, c in (rng.sample(themes[s], 3) for _ in range(rng.randrange(5, 8)))]
            truth.add((i, s))
            if i < 350:
                labels.append((i, s))
        other = next(s for s in themes if s not in mine)
        parts.append(f"As an aside, someone mentioned the {rng.choice(themes[other])} once.")
        rng.shuffle(parts)
        rows.append((i, " ".join(parts)))
    rows += [(900, None), (901, ""), (902, "Just a word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(777, "sea"), (3, "unknown")], "doc_id long, subject string")
    names = spark.createDataFrame([(s, "") for s in themes], "subject string, description string")
    got = {(r.doc_id, r.subject) for r in S.subjects_of(docs, lab, names).collect()}
    held = {x for x in truth if x[0] >= 350}
    mine = {x for x in got if x[0] >= 350}
    assert len(held & mine) / len(held) > 0.9 and len(held & mine) / max(1, len(mine)) > 0.9
    assert not {x for x in got if x[0] >= 900}
    assert S.subjects_of(docs.limit(0), lab, names).count() == 0
    assert S.subjects_of(docs, lab.limit(0), names).count() == 0
