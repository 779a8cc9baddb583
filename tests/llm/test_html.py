import pytest

from lumaspark.llm import html

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- note --><div class="ad">Buy now, it is cheap.</div>
<article><h1>The title &amp; more</h1><p><b>First   paragraph<br>of the text.<p>Second &eacute;&#233; one.<aside>Side box</aside></p>
<form>Name <input></form><div id="cookie-notice">We use cookies</div><p>Last.</p></article>
<div class="comments"><p>Reader says hello to everybody in a fairly long comment, which is no part of the article at all.</p></div>
<footer>&copy; me</footer></body></html>"""


def test_article():
    assert html.main_text(PAGE) == "The title & more First paragraph of the text. Second éé one. Last."


@pytest.mark.parametrize("cut", range(0, len(PAGE), 7))
def test_any_truncation_is_accepted(cut):
    assert isinstance(html.main_text(PAGE[:cut]), str)


def test_pages_without_article():
    body = "Plain text that runs on for quite a while, long enough to be the surge of this small page. " * 2
    page = f'<body><div class="menu"><a href="/">Home</a><a href="/b">B</a></div><div><a href="/x">{"link " * 40}</a></div><script>x</script><div>{body}</div><p>More.</p><div id="footer">end</div>'
    assert html.main_text(page) == f"{body.strip()} More."
    assert html.main_text("<p>tiny</p>") == "tiny"
    assert html.main_text("1 < 2 and 3 > 2") == "1 < 2 and 3 > 2"


def test_unclosed_junk_ends_where_the_article_begins():
    assert html.main_text("<nav><ul><li>menu<article><p>text</p></article>") == "text"
    assert html.main_text('<div class="ad">x<div>y</div>z</div><main>kept <i>wo</i>rd</main>') == "kept word"


def test_regions():
    assert html.regions([0, 50, 60, 0, 0, 0, 5, 0, 0, 0, 90], surge=80) == [(1, 3), (10, 11)]
    assert html.regions([], surge=1) == []


def test_table(spark):
    rows = [(1, "http://a", PAGE), (2, None, None), (3, "u", ""), (3, "u", ""), (None, "v", "<article>é</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "7 as n_chars")
    got = html.extract_main_text(pages).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted(((i, u, html.main_text(h), len(html.main_text(h))) for i, u, h in rows), key=str)
    assert html.extract_main_text(pages.limit(0)).count() == 0
    long = "<article>" + "<p>word &amp; word</p>" * 50_000 + "</article>"
    assert len(html.main_text(long)) == 50_000 * 12 - 1


def test_dropped_elements_do_not_end_an_article_without_markup():
    long, late = ("Sentence of the article's first part. " * 80).strip(), ("Sentence of its last part. " * 22).strip()
    page = f'<body><div class="menu">Menu</div><div><p>{long}</p><div class="ad">Buy now</div><p>{late}</p><form>Name</form><p>The end.</p></div><footer>end</footer>'
    assert html.main_text(page) == f"{long} {late} The end."
    apart = f'<body><div>{long}</div><div class="ad">Buy</div><div>{late}</div><div class="ad">Buy</div><div><a href="/">{late}</a> and more text, but less than that within links, so none of an article.</div>'
    assert html.main_text(apart) == f"{long} {late}"


def test_part_of_a_name_is_no_evidence():
    text = "This paragraph belongs to the article and is as long as any other of it."
    for name in ("side-by-side", "login-story", "related-work", "social-science", "comment-on-results", "shareholders", "adventure"):
        assert html.main_text(f'<article><p>Start.</p><div class="{name}"><p>{text}</p></div><p id="{name}">End.</p></article>') == f"Start. {text} End."
    for name in ("ad", "ad-slot", "ad_300x250", "adBanner", "cookie-notice", "comment-list", "comment-5", "share-buttons", "post-comments", "related-posts", "x sidebar"):
        assert html.main_text(f'<article><p>Start.</p><div class="{name}"><p>{text}</p></div><p>End.</p></article>') == "Start. End."


def test_short_last_paragraph_after_a_list_of_links():
    body = "Plain text that runs on for quite a while, long enough to be the surge of this small page. " * 3
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(4))
    page = f"<body><div><p>{body}</p><ul>{links}</ul><p>The end.</p></div><div><ul>{links}</ul><p>Imprint.</p></div></body>"
    assert html.main_text(page) == f"{body.strip()} The end."


def test_dives_within_an_article():
    links = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(5))
    assert html.main_text(f'<article><h1><a href="/">Title</a></h1><p>Text.</p><ul>{links}</ul><p>More.</p><p><a href="/s">Source</a></p></article>') == "Title Text. More. Source"
    assert html.main_text(f"<article><ul>{links}</ul></article>") == "Link 0 Link 1 Link 2 Link 3 Link 4"


def test_void_and_open_elements():
    assert html.main_text('<article>a<img class="ad" src="x">b<br>c<hr>d<input>e') == "a b c d e"
    assert html.main_text("<article><p>one<div class=ad>x") == "one"


def brute_regions(weight, surge, window):
    """Every maximal run of starts of windows that hold anything, from its first line that weighs something."""
    holds = [sum(weight[i : i + window]) for i in range(len(weight))]
    found = []
    for a in range(len(weight)):
        for b in range(a + 1, len(weight) + 1):
            whole = all(holds[a:b]) and (a == 0 or not holds[a - 1]) and (b == len(weight) or not holds[b])
            if whole and max(holds[a:b]) >= surge:
                found.append((min(i for i in range(a, b) if weight[i]), b))
    return found


def test_regions_equal_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(300):
        weight = [rng.choice([0, 0, 0, rng.randint(1, 90)]) for _ in range(rng.randrange(25))]
        for surge in (1, 40, 120):
            assert html.regions(weight, surge) == brute_regions(weight, surge, html.WINDOW)


def test_very_long_page():
    page = "<div>" * 3000 + "<p>word</p>" * 50_000 + "<" * 3000 + "a " * 100_000
    assert len(html.main_text(page)) > 200_000
