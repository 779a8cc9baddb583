import random

from lumaspark.llm import quotes


def test_parse_levels():
    text = "Hello\nOn Monday, A wrote:\n> first\n> > second\n> third\n\nOwn again"
    assert quotes.parse(text) == [(0, "Hello"), (1, "first"), (2, "second"), (1, "third"), (0, "\nOwn again")]
    assert quotes.own_text(text) == "Hello\nOwn again"
    assert quotes.own_text(None) == "" and quotes.own_text("a > b") == "a > b"
    assert quotes.normalised(" A,  b!\nÇ ") == "a b ç"


def run(spark, rows, block=1024, least=1):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "2 as msg")
    return quotes.reply_ordered(table, block=block, least=least).collect()


def test_links(spark):
    rows = [
        (1, 0, "user", "The first message.\n\nIt has two parts."),
        (1, 1, "bot", "An answer to that."),
        (1, 2, "user", "> the FIRST message\nIndeed."),
        (1, 3, "bot", "> > It has two parts.\n> An answer to that.\nBoth."),
        (1, 4, "user", "> never said\nWhat?"),
        (1, 5, "user", "> What?\n> said later\nHm"),
        (1, 6, "user", "said later"),
        (2, 0, "user", "> The first message.\nOther conversation"),
        (2, 0, "user", "> The first message.\nOther conversation"),
        (None, 3, "user", "x"),
        (3, None, "user", "y"),
        (4, 9, None, None),
    ]
    for block in (1024, 2):
        got = run(spark, rows, block)
        assert len(got) == len(rows)
        by = {(r.conv_id, r.turn): r for r in got}
        assert [by[1, t].reply_to for t in range(7)] == [None, 0, 0, 1, 3, 4, 5]
        assert [by[1, t].position for t in range(7)] == list(range(7))
        assert by[1, 3].text == "Both." and (by[1, 3].n_quoted, by[1, 3].n_linked) == (2, 2)
        assert (by[1, 4].n_quoted, by[1, 4].n_linked) == (1, 0) and (by[1, 5].n_quoted, by[1, 5].n_linked) == (3, 1)
        assert by[2, 0].reply_to is None and by[2, 0].n_linked == 0 and by[2, 0].position == 0
        assert by[None, 3].position is None and by[3, None].reply_to is None and by[4, 9].text == ""


def test_positions_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(40), "u", f"m{i}") for i in range(150)]
    for block in (1024, 7):
        for r in run(spark, rows, block):
            own = [t for c, t, _, _ in rows if c == r.conv_id]
            assert r.position == sum(t < r.turn for t in own)
            assert r.reply_to == max((t for t in own if t < r.turn), default=None)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_short_passages_and_long_texts(spark):
    long = "\n".join(f"line number {i} of a long message" for i in range(20_000))
    rows = [(1, 0, "u", "Yes"), (1, 1, "u", "Another remark"), (1, 2, "u", "> Yes\n> Another remark\nWell"), (1, 3, "u", "> Yes\nNo"), (2, 0, "u", long), (2, 1, "u", "> line number 19999 of a long message\nok"), (2, 2, "u", "> " + long.replace("\n", "\n> "))]
    by = {(r.conv_id, r.turn): r for r in run(spark, rows, least=quotes.LEAST)}
    assert (by[1, 2].n_quoted, by[1, 2].n_linked, by[1, 2].reply_to, by[1, 2].text) == (2, 1, 1, "Well")
    assert (by[1, 3].n_quoted, by[1, 3].reply_to, by[1, 3].text) == (0, 2, "No")
    assert by[2, 1].reply_to == 0 and by[2, 2].n_quoted == by[2, 2].n_linked == 20_001 and by[2, 2].text == ""
