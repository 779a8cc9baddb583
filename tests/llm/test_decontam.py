import random
import re

import pytest

from lumaspark.llm import decontam

WORDS = "the of and orbit lamp river stone cloud green seven under over table glass paper light never always".split()
ITEM = "A train leaves Paris at 9 pm and travels 120 km to Lyon in 3 hours before it turns round"


def pairs(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as words", "2 as size")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 as doc_id")
    return {(r.doc_id, r.item_id): r for r in decontam.contaminated(d, b, **options).collect()}


def plain(text):
    return re.sub(r"[^a-z0-9]+", " ", (text or "").lower()).split()


def brute(docs, items, window=6, least=0.5):
    out = set()
    for item, text in items:
        words = plain(text)
        size = min(window, len(words))
        if len(words) < 4:
            continue
        own = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        for doc, body in docs:
            w = plain(body)
            there = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            if len(own & there) >= least * len(own):
                out.add((doc, item))
    return out


def test_equals_brute_force_without_placeholders(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))
    items = [(i, prose(rng.randint(3, 30))) for i in range(30)] + [(90, None), (91, ""), (92, "!!")]
    docs = []
    for i in range(120):
        body = prose(rng.randint(0, 60)).split()
        if i % 3 == 0:
            words = (rng.choice(items[:30])[1]).split()
            cut = rng.randint(0, len(words) // 2)
            body[len(body) // 2 : len(body) // 2] = words[cut:] if i % 2 else words
        text = " ".join(body)
        docs.append((i, rng.choice((text, text.upper(), text.replace(" ", "### ")))))
    docs += [(500, None), (501, ""), (502, "..."), (503, " ".join(items[0][1].split() * 300))]
    found = pairs(spark, docs, items)
    assert set(found) == brute(docs, items) and len(found) > 20
    assert all(r.n_slots == 0 for r in found.values())


def test_changed_numbers_names_and_units(spark):
    docs = [
        (1, "Before. " + ITEM + ". After."),
        (2, "Before. A train leaves Rome at 7 pm and travels 300 miles to Oslo in 5 hours before it turns round."),
        (3, "A train leaves somewhere at night and travels far away to another place in some hours before dawn."),
        (4, "unrelated text about a train and 5 km"),
    ]
    found = pairs(spark, docs, [(7, ITEM)])
    assert set(found) == {(1, 7), (2, 7)}
    assert found[1, 7].n_slots > 0 and found[1, 7].n_slots == found[1, 7].n_consistent == found[2, 7].n_consistent


def test_slots_must_correspond(spark):
    item = "if 4 plus 4 gives 8 then 8 minus 4 gives 4 and nothing is left of the 4 but 8"
    same = "if 5 plus 5 gives 9 then 9 minus 5 gives 5 and nothing is left of the 5 but 9"
    mixed = "if 1 plus 2 gives 3 then 5 minus 6 gives 7 and nothing is left of the 9 but 11"
    found = pairs(spark, [(1, same), (2, mixed)], [(1, item)])
    assert set(found) == {(1, 1)}


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs, items = [(1, ITEM), (2, ITEM + " again"), (None, ITEM)], [(1, ITEM), (2, "orbit lamp river stone"), (None, "x")]
    first = set(pairs(spark, docs, items))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert set(pairs(spark, docs, items)) == first == {(1, 1), (2, 1)}


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a b c")]), ([(1, "a b c")], [])])
def test_empty_tables(spark, docs, items):
    assert pairs(spark, docs, items) == {}


def test_plan_is_native(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    plan = decontam.contaminated(d, d.withColumnRenamed("doc_id", "item_id"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_names_at_sentence_starts(spark):
    item = "Tom has 12 apples. Anna gives him 5 more. Clara Smith takes 3 of the apples away. Peter asks how many are left now."
    docs = [
        (1, "Intro. Kate has 7 apples. Paul gives him 9 more. Maria takes 2 of the apples away. Oscar Brown asks how many are left now. End."),
        (2, "Intro. Kate sees 7 pears. Paul sells him 9 boats. Maria paints 2 of the walls red. Oscar asks nobody at all about it."),
    ]
    assert set(pairs(spark, docs, [(1, item)])) == {(1, 1)}


def test_items_of_placeholders_are_found_as_written(spark):
    items = [(1, "12 + 7 - 5 * 3 = 4"), (2, "3 kg, 4 km, 5 s, 6 m"), (3, ITEM)]
    docs = [(1, "Before: 12 + 7 - 5 * 3 = 4, after."), (2, "It has 13 + 8 - 6 * 2 = 9 of them."), (3, "List: 3 kg, 4 km, 5 s, 6 m."), (4, ITEM)]
    found = pairs(spark, docs, items)
    assert set(found) == {(1, 1), (3, 2), (4, 3)}
    assert found[1, 1].n_windows == found[1, 1].n_matched == 1


def test_items_of_few_words_are_no_evidence(spark):
    assert pairs(spark, [(1, "a cat sat")], [(1, "cat"), (2, "a cat sat"), (3, "Cat?")]) == {}
    assert set(pairs(spark, [(1, "a cat sat")], [(1, "cat")], least_words=1)) == {(1, 1)}


def test_very_long_runs(spark):
    """Names, numbers and a line without an end, each of 20,000 words, with an item behind them."""
    docs = [
        (1, "Anna " * 20_000 + "end. " + ITEM),
        (2, "12," * 20_000 + " end. " + ITEM),
        (3, "word " * 20_000 + ITEM),
        (4, "12 km " * 20_000 + ITEM),
        (5, "Anna" * 20_000 + " " + "1" * 20_000 + " " + ITEM),
        (6, "Anna " * 20_000),
    ]
    assert set(pairs(spark, docs, [(1, ITEM)])) == {(i, 1) for i in range(1, 6)}


def brute_slots(text, item, window=6):
    """Meetings of placeholder values, by plain loops, for texts without names at sentence starts."""

    def template(t):
        words, found = [], []
        for w in re.findall(r"[A-Za-z]+|[0-9]+", t):
            if w.isdigit():
                words.append("#")
                found.append("#" + w)
            elif words and w[0].isupper():
                words.append("@")
                found.append("@" + w)
            elif words and words[-1] == "#" and w in decontam.UNITS.split("|"):
                words.append("~")
                found.append("~" + w)
            else:
                words.append(w.lower())
                found.append(None)
        return words, found

    (a, av), (b, bv) = template(item), template(text)
    met = {}
    for i in range(len(a) - window + 1):
        for j in range(len(b) - window + 1):
            cut = a[i : i + window]
            if cut == b[j : j + window] and 2 * sum(w in "#@~" for w in cut) <= window:
                for k in range(window):
                    if av[i + k]:
                        met.setdefault(av[i + k], []).append(bv[j + k])
    return sum(map(len, met.values())), sum(max(map(v.count, v)) for v in met.values())


def test_slots_equal_brute_force(spark):
    rng = random.Random(12)
    items = [(i, "") for i in range(8)]
    docs = []
    for i, _ in items:
        words = ["so"] + [rng.choice([rng.choice(WORDS), rng.choice(WORDS), str(rng.randint(1, 9)), "Paris", f"{rng.randint(1, 9)} km"]) for _ in range(40)]
        words = [w for k, w in enumerate(words) if not (w[0].isupper() and words[k - 1][0].isupper())]
        items[i] = (i, " ".join(words))
        same = {str(n): str(n + 10) for n in range(10)} | {"Paris": "Rome"}
        changed = [re.sub(r"[0-9]+|Paris", lambda m: same[m[0]] if rng.random() < 0.9 else m[0], w) for w in words]
        docs.append((100 + i, "and " + " ".join(changed) + " or"))
    docs += [(100, docs[0][1])] * 2
    found = pairs(spark, docs, items)
    assert {(100 + i, i) for i in range(8)} == set(found)
    text = dict(docs)
    for (doc, item), r in found.items():
        assert (r.n_slots, r.n_consistent) == brute_slots(text[doc], dict(items)[item]), (doc, item)
    assert sum(r.n_slots for r in found.values()) > 100


def test_repeated_ids(spark):
    rows = [(1, ITEM)] * 40 + [(1, "other words " + ITEM)] * 40
    (row,) = pairs(spark, rows, [(7, ITEM), (7, ITEM)]).values()
    assert row.n_matched == row.n_windows and row.n_slots == row.n_consistent
