import corpus_pipeline
from lumaspark.llm import queries
from lumaspark.llm.scratch import Scratch

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, scratch = [docs.count()], Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, SF), name)
        assert out.dtypes == docs.dtypes
        assert out.join(docs, docs.columns[:2], "left_anti").count() == 0
        docs = out
        counts.append(out.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.6 * counts[0] and counts[-1] < counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == counts[-1]


def test_registered():
    assert [n for n in queries.queries()] and all(n.startswith("op") for n in queries.queries())
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def test_guard(tmp_path):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def small_tables(spark, path, rows, labels, items):
    extra = ["'x' as score", "1 as _gone", "true as kept", "2 as n_tokens"]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_decisions_and_edge_cases(spark, tmp_path):
    import random

    rng = random.Random(9)
    word = lambda: rng.choice(["ka", "lo", "mi"]) + rng.choice(["ren", "tos", "vul"]) + rng.choice(["a", "e", "is"]) + str(rng.randrange(9)) * 0
    clean = lambda n: " ".join(word() + rng.choice("abcdefgh") for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        words = clean(rng.randint(20, 60)).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grubber", "snollig"]))
        rows.append((i, " ".join(words), "aa", "s", 1))
        labels.append((i, 1, int(toxic)))
    item = clean(20)
    base = clean(40)
    rows += [(1000, base, "aa", None, None), (1001, base.upper(), None, "s", 1), (1002, base + " tail", "aa", "s", 1)]
    rows += [(1010, clean(10) + " " + item + " " + clean(10), "aa", "s", 1), (1020, None, "aa", "s", 1), (1021, "", None, None, None), (1022, "12 34 !", "aa", "s", 1)]
    rows += [(1030, clean(30), None, None, None), (None, clean(30), "aa", "s", 1), (1040, " ".join(clean(15) for _ in range(400)), "aa", "s", 1)]
    rows += [(1050, "grubber snollig " + clean(30) + " grubber", "aa", "s", 1)]
    small_tables(spark, tmp_path, rows, labels, [(1, item), (2, None)])
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {1000, 1030, None, 1040} <= set(got) and not {1001, 1002, 1010, 1020, 1021, 1022, 1050} & set(got)
    kept = [i for i in range(300) if i in got]
    assert sum(i % 4 != 0 for i in kept) >= 220 and sum(i % 4 == 0 for i in kept) <= 2
    assert got[1040] > 6000


def test_empty_tables(spark, tmp_path):
    small_tables(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for query in (queries.op4_toxicity, queries.op10_language_id, queries.op7_benchmark_decontamination, queries.op1_minhash_near_dedup):
        assert query(spark, str(tmp_path)).count() == 0


def test_one_row_of_a_group_stays_with_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    rows = [(5, text("a")), (1, text("a")), (1, text("a")), (None, text("a")), (None, text("b")), (None, text("b")), (2, text("c")), (3, ""), (4, "")]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, text("a")), (None, text("b")), (2, text("c")), (3, ""), (4, "")], key=str)


def test_language_stage_shuffles_no_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = corpus_pipeline.drop_unknown_language(spark, docs, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text#" in plan and "BroadcastExchange" in plan
    assert "Exchange hashpartitioning" not in plan and "Sort " not in plan
