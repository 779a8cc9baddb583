import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lumaspark.llm import langid

SOUNDS = {"aa": "ka ko ku mi ma na".split(), "bb": "str ing ung schn er ek".split(), "cc": "eau oui ette onn ille ais".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def corpus(n=240):
    rng = random.Random(6)
    return [(i, text(rng, lang, rng.randint(5, 40)), lang) for i in range(n) for lang in [rng.choice(sorted(SOUNDS))]]


def split(text):
    """Runs of letters and marks with a letter, lower-cased a character at a time."""
    out, run = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] in "LM":
            run += c.lower() if len(c.lower()) == 1 else c
        else:
            if any(x.isalpha() for x in run):
                out.append(run)
            run = ""
    return out


def brute(rows, train):
    """Predictions by plain loops over dictionaries."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for _, body, lang in train:
        for w in split(body) if lang is not None else []:
            words[lang][w] += 1
            for k in range(1, 6):
                for i in range(len(w) + 3 - k):
                    grams[lang][f"^{w}$"[i : i + k]] += 1
    languages = sorted(words)

    def scores(table):
        keys = {k for c in table.values() for k in c}
        return {k: [math.log(table[x][k] + 0.5) - math.log(sum(table[x].values()) + 0.5 * len(keys)) for x in languages] for k in keys}

    word_scores, gram_scores = scores(words), scores(grams)

    def vector(word):
        if word in word_scores:
            return word_scores[word]
        marked, found = f"^{word}$", []
        for at in range(1, len(marked)):
            endings = (marked[at + 1 - n : at + 1] for n in range(min(5, at + 1), 0, -1))
            hit = next((gram_scores[e] for e in endings if e in gram_scores), None)
            found += [hit] if hit else []
        return [sum(x) / len(found) for x in zip(*found, strict=True)]

    out = []
    for doc, body, _ in rows:
        own = split(body)
        if not own or not languages:
            out.append((doc, "und", 0.0))
            continue
        total = [round(sum(x) / len(own) ** 0.5, 6) for x in zip(*map(vector, own), strict=True)]
        out.append((doc, languages[total.index(max(total))], 1 / sum(math.exp(x - max(total)) for x in total)))
    return out


def compared(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, round(r[2], 4))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-5)


EDGES = [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (903, "kako", None), (None, "stringung", "bb"), (904, "KAKO-KAMI", "aa"), (905, "\u0301 \u0301", "aa")]


def test_held_out_accuracy_and_edges(spark):
    rows = [*corpus(), *EDGES]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "0.5 as n", "1 as h", "'x' as scores", "2 as _lang_row")
    rest = langid.split_remainder(F.col("doc_id"), 3)
    model = langid.train(docs.where(rest != 1))
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].lang_pred == truth[i] for i in held) > 0.97 * len(held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902, 905))
    assert got[903].lang_pred == "aa" and got[904].lang_pred == "aa" and got[None].lang_pred == "bb"
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("broadcast", [0, 3, 65_536])
def test_equals_brute_force(spark, broadcast):
    """With few, some or all words broadcast: the results are the same."""
    rng = random.Random(4)
    train = [*corpus(60), *EDGES, (906, "Straße ÉTÉ İstanbul cafe\u0301 \u0939\u093f\u0928\u094d\u0926\u0940", "dd"), (906, "Straße", "dd")]
    unseen = ["".join(rng.choice("kaeiostrngu") for _ in range(rng.randint(1, 12))) for _ in range(80)]
    rows = [*train, (907, " ".join(unseen), None), (908, "\u0939\u093f\u0928\u094d\u0926 \u0904 zzz qqq", None), (909, "x" * 30_000, None), (909, "x" * 30_000, None)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(3)
    model = langid.train(docs, broadcast_keys=broadcast)
    every = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    compared(langid.identify(every, model).collect(), brute(rows, train))


def test_counts(spark):
    docs = spark.createDataFrame([("abc abc xyz", "l"), ("qqq abc", "m"), (None, "n"), ("1 2", "o")], "text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["l", "m"]
    assert {r.key: r.n for r in model.words.collect()} == {"abc": 3, "xyz": 1, "qqq": 1}
    grams = {r.key: r.n for r in model.grams.collect()}
    assert grams["^abc"] == grams["abc$"] == 3 and grams["c"] == 3 and grams["q"] == 3 and grams["$"] == 5 and max(map(len, grams)) == langid.LONGEST


def test_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([("abc", "m"), ("abc", "l")], "text string, lang string")
    rows = spark.createDataFrame([(1, "abc"), (2, "zzz"), (3, "abd")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in langid.identify(rows, langid.train(docs)).collect()} == {("l", 0.5)}


def test_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    row = langid.identify(docs, model).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.identify(docs.limit(0), langid.train(docs.selectExpr("text", "'l' as lang"))).count() == 0


@pytest.mark.parametrize("broadcast_rows", [langid.BROADCAST_ROWS, 0])
def test_retained_rows_are_those_identified(spark, broadcast_rows):
    rows = [*corpus(60), (None, "zqx zqx", None), (900, None, "aa"), (901, "", None), (902, "12 !", "bb"), (903, "mako ungek", None), (903, "mako ungek", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    condition = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.9)
    for model in (langid.train(docs.where("doc_id % 3 = 0"), broadcast_keys=20), langid.train(docs.limit(0))):
        want = langid.identify(docs, model, keep=docs.columns).where(condition).select(*docs.columns)
        got = langid.retain(docs, model, condition, keep=docs.columns, broadcast_rows=broadcast_rows)
        assert got.dtypes == docs.dtypes
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert got.count() < len(rows) and (got.count() > 0 or not model.languages)
