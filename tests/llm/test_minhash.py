import random

import numpy as np
import pytest

from lumaspark.llm import minhash, uneven
from lumaspark.llm.graph import connected_components
from lumaspark.llm.scratch import Scratch

UPPER = {c: c + 32 for c in range(65, 91)}


def shingles(text, size=5):
    words = [w for w in "".join(chr(UPPER.get(ord(c), ord(c))) if c not in " \t\n\x0b\x0c\r" else " " for c in text or "").split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if len(words) >= size else {tuple(words)}


def brute(rows, percent=75):
    """(id, size, smallest id of the component) of each row; rows link by their own texts."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(sets):
        for j, b in enumerate(sets[:n]):
            if rows[n][0] is not None and rows[j][0] is not None and a and 100 * len(a & b) >= percent * len(a | b):
                parent[root(n)] = root(j)
    lowest = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            lowest[root(n)] = min(i, lowest.get(root(n), i))
    return {(i, len(a), lowest.get(root(n)) if i is not None else None) for n, ((i, _), a) in enumerate(zip(rows, sets, strict=True))}


def corpus(rng):
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz") + str(rng.randrange(40))
    rows, n = [], 0
    shared = [word() for _ in range(30)]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(8, 90))]
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            text = " ".join(copy)
            rows.append((n, rng.choice((text, text.upper(), text.replace(" ", "\n ")))))
            n += 1
    for _ in range(25):
        rows.append((n, " ".join([*(word() for _ in range(rng.randint(3, 60))), *shared])))
        n += 1
    return rows


@pytest.mark.parametrize("group_limit", [4096, 3])
def test_equals_brute_force(spark, group_limit):
    rows = corpus(random.Random(11))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one two"), (904, "ONE  two"), (905, "one"), (None, "one two"), (906, "naïve É x y z"), (907, "naïve é x y z"), (903, "one two")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, id int, component_id string")
    got = minhash.near_duplicate_classes(docs, group_limit=group_limit).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_empty_table(spark):
    assert minhash.near_duplicate_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64) * np.uint64(2)
    for shared in (0, 500, 900):
        a, b = pool[:1000], np.r_[pool[:shared], pool[2000 : 3000 - shared]]
        regs = minhash.registers(np.r_[a, b], np.array([0, 1000, 2000]), 128)
        got = minhash.estimate(regs[:1], regs[1:], np.array([1000]), np.array([1000]))[0]
        assert abs(got - shared / (2000 - shared)) < 0.17
    assert 0 < minhash.chance_match(np.array([1000]), np.array([1000]))[0] < 0.01


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(500, x) for x in range(501, 560)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if None not in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark))
    assert {(r.id, r.comp) for r in found.collect()} == {(x, root(x)) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_large_buckets_are_compared_completely(spark):
    """Pairs that share few bands are found in buckets of any size."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    hot = [word() for _ in range(24)]
    rows = [(i, " ".join([*hot, *(word() for _ in range(rng.randint(8, 30)))])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda limit: {(r.doc_id, r.component_id) for r in minhash.near_duplicate_classes(docs, percent=43, group_limit=limit).collect()}
    whole = run(4096)
    assert 20 < len({c for _, c in whole}) < 150
    assert run(8) == whole


def test_repeated_ids(spark):
    """300 different texts under two ids, some of them linked, and a text that a hundred rows repeat."""
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    shared = [word() for _ in range(60)]
    rows = []
    for k in range(300):
        own = [word() for _ in range(40)] if k % 3 else shared[:50] + [word() for _ in range(rng.randrange(12))]
        rows.append((k % 2 + 5, " ".join(own)))
    rows += [(5, "the same seven words in each row"), (7, "the same seven words in each row")] * 50 + [(2, " ".join(shared[:50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = minhash.near_duplicate_classes(docs).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_heavy_keys_and_long_texts(spark, monkeypatch):
    """Classes and components that many rows share go by broadcast; a text of 100,000 words is compared whole."""
    monkeypatch.setattr(uneven, "LEAST_HOT", 3)
    monkeypatch.setattr(uneven, "HOT_SHARE", 10)
    rng = random.Random(9)
    long = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    near = [w if k % 100 else "changed" for k, w in enumerate(long)]
    rows = corpus(rng) + [(2000 + k, "alpha beta gamma delta epsilon zeta") for k in range(60)] + [(1999, " ".join(long)), (3000, " ".join(near)), (3001, " ".join(long[:50_000]))]
    got = minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute(rows)
    assert {r.component_id for r in got if r.doc_id in (1999, 3000)} == {1999} and {r.component_id for r in got if r.doc_id == 3001} == {3001}
