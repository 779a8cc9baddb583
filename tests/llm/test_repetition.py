import random
import re

import numpy as np
import pyarrow as pa

from lumaspark.llm import repetition
from lumaspark.llm.textkit import Words, chunks


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def brute_longest(w):
    out = [0] * len(w)
    for i in range(len(w)):
        for j in range(len(w)):
            n = 0
            while i != j and i + n < len(w) and j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            out[i] = max(out[i], n)
    return out


def brute_cover(longest, least):
    inside = set()
    for i, n in enumerate(longest):
        if n >= least:
            inside.update(range(i, i + n))
    return len(inside)


def test_longest_repeats_equal_brute_force():
    rng = random.Random(1)
    for _ in range(80):
        texts = [" ".join(rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))) for _ in range(5)]
        for _, _, data, offsets in chunks(pa.array(texts)):
            w = Words(data, offsets, lower=False)
            got = repetition.longest_repeats(w.hashes(), w.first)
            want = [brute_longest(words_of(t)) for t in texts]
            assert got.tolist() == [n for t in want for n in t]
            for least in (1, 2, 5):
                assert repetition.covered(got, w.first, least).tolist() == [brute_cover(t, least) for t in want]


def test_table_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "  \n", "a b c", "same line\nsame line\n same line\nx", "É é É é É é É é É é É é", "one two three four five six seven eight nine ten #*$ <b> | a&b 100%"]
    for _ in range(40):
        base = [rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.randint(5, 150))]
        if rng.random() < 0.6:
            base += base[: rng.randint(1, len(base))]
        texts.append(" ".join(base).replace(" a", "\na"))
    texts.append(" ".join(f"u{i}" for i in range(60)) + " " + " ".join(f"v{i}" for i in range(900)) + " " + " ".join(f"u{i}" for i in range(60)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "true as kept", "1 as id")
    got = {r.doc_id: r for r in repetition.repetition_quality(docs).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        w, r = words_of(text), got[i]
        longest = brute_longest(w) if len(w) < 400 else None
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        again = {k + d for k, x in enumerate(windows) if windows.count(x) > 1 for d in range(5)} if len(w) < 400 else set(range(120))
        lines = (text or "").split("\n")
        dup = sum(1 for k, line in enumerate(lines) if words_of(line) and line in lines[:k])
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (
            len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(again), failed
        )
        if longest is not None:
            assert (r.covered_words, r.longest_repeat) == (brute_cover(longest, 8), max(longest, default=0))
            assert r.kept == (not failed and r.covered_words <= 0.2 * len(w) and r.longest_repeat <= 50)
    last = got[len(texts) - 1]
    assert not last.base_failed and not last.kept and last.longest_repeat == 60
    assert repetition.repetition_quality(docs.limit(0)).count() == 0


def test_very_repetitive_text_is_fast():
    w = np.zeros(20_000, dtype=np.uint64)
    got = repetition.longest_repeats(w, np.array([0, len(w)]))
    assert got[0] == len(w) - 1 and repetition.covered(got, np.array([0, len(w)]), 8)[0] == len(w)
