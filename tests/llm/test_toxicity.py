import random

import numpy as np
import pyarrow as pa

from lumaspark.llm import toxicity

BAD = "grubber snollig frumpo vilnash".split()


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(("x", "y"))
        words = [rng.choice("abcdefghijkl") + ("ing" if lang == "x" else "ova") + str(rng.randrange(300)) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(("", ",", "!")))
        rows.append((i, " ".join(words), lang, toxic))
    return rows


def test_learns_from_a_bounded_sample(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] + [(900, None, "x"), (901, "", None), (901, "", None), (None, "grubber", "x")], "doc_id long, text string, lang string").selectExpr("*", "9 as toxic")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows[:500]] + [(3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, most_each=200)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum(got[i].predicted == x for i, _, _, x in rows[500:])
    assert right >= 190
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[900].score == got[901].score and got[None].predicted == 1
    assert model.languages == ["x", "y"]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_degenerate_labels():
    assert toxicity.fit([], [], []).intercept == 0
    for label in (0, 1):
        model = toxicity.fit(["a b", None], [label, label], ["x", None])
        for _, _, slots, which, first in toxicity.features(pa.array(["anything", ""])):
            assert ((model.scores(slots, which, first) > 0.5) == bool(label)).all()


def test_scores_do_not_depend_on_batches():
    rows = corpus(60)
    model = toxicity.fit([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], epochs=1)
    texts = pa.array([r[1] for r in rows] + ["", "one"])
    whole = np.concatenate([model.scores(s, w, f) for _, _, s, w, f in toxicity.features(texts)])
    small = np.concatenate([model.scores(s, w, f) for _, _, s, w, f in toxicity.features(texts, limit=50)])
    assert np.allclose(whole, small, atol=1e-5)


def plain_logit(model, slots, order):
    """One text's logit by plain loops: embeddings, filters at every place, maxima, logistic layer."""
    words = [sum(model.table[s] for s in slots[w]) for w in order] + [np.zeros(toxicity.SIZE)] * toxicity.PAD
    hidden = []
    for weights in model.filters:
        for f in range(toxicity.FILTERS):
            hidden.append(max(sum(float(words[at + k] @ weights[k][:, f]) for k in range(len(weights))) for at in range(len(order))))
    return sum(max(0.0, h + b) * o for h, b, o in zip(hidden, model.bias, model.out, strict=True)) + model.intercept


def test_equals_plain_loops():
    model = toxicity.fit([r[1] for r in corpus(80)], [r[3] for r in corpus(80)], [r[2] for r in corpus(80)], epochs=1)
    examples = toxicity._examples([r[1] for r in corpus(12, seed=5)] + ["one", "a b"])
    got = model.logits(*toxicity._joined(examples))
    assert np.allclose(got, [plain_logit(model, s.astype(int), o) for s, o in examples], atol=1e-4)


def test_gradient_equals_differences():
    """A step of Adagrad moves each weight against the sign of the loss's slope."""
    rows = corpus(20, seed=2)
    examples, y = toxicity._examples([r[1] for r in rows]), np.array([r[3] for r in rows], float)
    model, drop = toxicity.Classifier.fresh(3), np.ones((len(rows), len(toxicity.WIDTHS) * toxicity.FILTERS))

    def loss(m):
        z = m.logits(*toxicity._joined(examples))
        return float(np.mean(np.logaddexp(0, z) - y * z))

    before = [w.copy() for w in model.filters]
    slopes = []
    for k, at in ((0, (0, 3, 5)), (1, (1, 2, 7)), (2, (2, 9, 1))):
        probe = toxicity.Classifier.fresh(3)
        probe.filters[k][at] += 1e-2
        up = loss(probe)
        probe.filters[k][at] -= 2e-2
        slopes.append((k, at, (up - loss(probe)) / 2e-2))
    toxicity._step(model, examples, y, {}, 0.01, drop, 0.0)
    for k, at, slope in slopes:
        if abs(slope) > 1e-4:
            assert np.sign(model.filters[k][at] - before[k][at]) == -np.sign(slope)


def test_contradictory_marks_and_repeated_ids(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, _ in rows] * 3 + [(0, "other", "x")], "doc_id long, text string, lang string")
    marks = [(i, x) for i, _, _, x in rows]
    both = [toxicity.train(docs.repartition(n), spark.createDataFrame(m, "doc_id long, toxic int")) for n, m in ((2, [*marks, (5, 1), (5, 0)]), (5, [(5, 0), (5, 1), *marks[::-1]]))]
    assert all((a == b).all() for a, b in zip(both[0].filters, both[1].filters, strict=True)) and both[0].intercept == both[1].intercept
    assert toxicity.train(docs, spark.createDataFrame(marks, "doc_id long, toxic int"), most_bytes=0).intercept == 0
