"""Operator 6: templates, odd markup and odd tables."""

import random

import pytest

from tallyspark.llm.html_text import extract, extracted, op6_html
from pyspark.sql import functions as F

LONG = "A sentence, with commas, that is long enough to count as text, of an article, surely."

CASES = {
    "article": (f"<html><head><title>t</title><style>p{{}}</style><script>var a='</p>';</script></head><body><nav><a href=/>home</a></nav><article><h1>Head</h1><p><b>{LONG}<br><p>Two &amp; three</p></article><footer>f</footer></body></html>", f"Head\n{LONG}\nTwo & three"),
    "divs": (f"<body><div id=header>Logo</div><div class='menu'><ul><li><a href=a>A</a></ul></div><div class=content><h2>T</h2><p>{LONG}</p><p>{LONG}</p><div class='ad-box'>Buy</div></div><div id='comments'><p>{LONG} {LONG}</p></div></body>", f"T\n{LONG}\n{LONG}"),
    "siblings": (f"<body><div><div class=x><p>{LONG}</p><p>{LONG}</p></div><div class=y><p>{LONG}</p><p>{LONG}</p></div></div><aside>side</aside></body>", "\n".join([LONG] * 4)),
    "spaces": ("<article><p>a\n\t b&nbsp;c</p><p> </p><p>d</p></article>", "a b c\nd"),
    "entities": ("<article><p>&lt;b&gt; &#65;&#x42; &copy; &eacute;</p></article>", "<b> AB © é"),
    "unclosed": (f"<article><p>{LONG}<p>two<ul><li>one<li>two</ul>", f"{LONG}\ntwo\none\ntwo"),
    "form": (f"<article><p>{LONG}</p><form><input><button>Go</button></form><p>end</p></article>", f"{LONG}\nend"),
    "comment": (f"<article><!-- <p>no</p> --><p>{LONG}</p><!-- open", LONG),
    "hidden": (f"<article><p>{LONG}</p><div hidden>no</div><div style='display:none'>no</div></article>", LONG),
    "comments inside": (f"<main><article class='post'><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article></main>", LONG),
    "cookie": (f"<body><div class='cookie-notice'><p>{LONG} {LONG}</p></div><div id=main><p>{LONG}</p></div></body>", LONG),
    "plain": ("just text", "just text"), "none": ("", ""), "only script": ("<script>x</script>", ""), "broken": ("<a <b <<p", "<<p"),
}


@pytest.mark.parametrize("name", CASES)
def test_case(name):
    page, text = CASES[name]
    if name == "broken":
        assert isinstance(extract(page), str)
    else:
        assert extract(page) == text


def test_null_and_long():
    assert extract(None) == ""
    page = "<article>" + "".join(f"<p>paragraph {i}, with a comma</p>" for i in range(20_000)) + "</article>"
    assert extract(page).count("\n") == 19_999
    assert extract("<div>" * 3000 + f"<p>{LONG}</p>") == LONG


def test_table(spark):
    pages = spark.createDataFrame([(1, "<article><p>x</p></article>"), (1, "<article><p>x</p></article>"), (None, None)], "page_id long, html string")
    assert [r["t"] for r in pages.select(extracted(F.col("html")).alias("t")).collect()] == ["x", "x", ""]
    assert pages.limit(0).select(extracted(F.col("html"))).count() == 0
    got = op6_html(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.filter("n_chars = 0 OR text LIKE '%<p>%'").count() == 0


SLUGS = ["side-effects", "social-impact", "related-work", "search-algorithms", "legal-history", "sharing-data", "alert-levels", "navier-stokes", "promoter-regions", "social_structure"]


@pytest.mark.parametrize("slug", SLUGS)
@pytest.mark.parametrize("whole", ["<article>{}</article>", "<body><div class=content>{}</div></body>"])
def test_ids_made_from_headings_stay(slug, whole):
    title = slug.replace("-", " ")
    part = f"<p>{LONG}</p><h2 id='{slug}'>{title}</h2><p id='{slug}'>a <span id='{slug}' class='{slug}'>b</span> c</p><section id='{slug}'><h3>{title}</h3><p>{LONG}</p></section><div id='{slug}'><p>{LONG}</p></div>"
    assert extract(whole.format(part)) == "\n".join([LONG, title, "a b c", title, LONG, LONG])


def test_names_in_an_article():
    part = f"<div class='entry-header'><h1>T</h1></div><p>{LONG}</p><section id='search'><h2>Search</h2><p>{LONG}</p></section>"
    apart = "<div id='related-posts'><p>no</p></div><div id='search-box'>no</div><div id='search'>no</div><div class='share-links'>no</div><ul id='social-profiles-here'><li><a href=x>no, no</a></li></ul><div id='comments'><h2>C</h2><p>no</p></div>"
    assert extract(f"<article>{part}{apart}</article>") == f"T\n{LONG}\nSearch\n{LONG}"
    assert extract(f"<body><div class='post category-legal tag-search'><p>{LONG}</p></div></body>") == LONG


PARTS = {
    "uneven": (f"<div class=part>{f'<p>{LONG}</p>' * 5}</div><div class=part><p>Short end.</p></div>", [LONG] * 5 + ["Short end."]),
    "other classes": (f"<div><p>Short start.</p></div><div class=x>{f'<p>{LONG}</p>' * 5}</div><section><p>Short end.</p></section>", ["Short start.", *[LONG] * 5, "Short end."]),
    "texts between": (f"Before <b>it</b><div class=x>{f'<p>{LONG}</p>' * 5}</div>between<br>two<div class=y><p>Short end.</p></div>after", ["Before it", *[LONG] * 5, "between two", "Short end.", "after"]),
    "alone in wrappers": (f"<div><div>{f'<p>{LONG}</p>' * 5}</div></div><div><div><p>Short end.</p></div></div>", [LONG] * 5 + ["Short end."]),
    "part of links": (f"<div class=part>{f'<p>{LONG}</p>' * 5}</div><div class=part><p><a href=x>A source</a></p></div>", [LONG] * 5 + ["A source"]),
    "lists of links": (f"<div class=part>{f'<p>{LONG}</p>' * 5}</div><div><a href=x>A, of links</a> <a href=y>B</a></div><a href=z>next</a>", [LONG] * 5),
}


@pytest.mark.parametrize("name", PARTS)
def test_parts_of_an_article_without_its_element(name):
    part, texts = PARTS[name]
    assert extract(f"<body><div class=menu><a href=x>home</a></div><div class=page>{part}</div></body>") == "\n".join(texts)


ODD = {
    "apostrophes": (f"<article><p title=don't>First.</p><p>it's second.</p><p>{LONG}</p></article>", f"First.\nit's second.\n{LONG}"),
    "quotes hold marks": (f"<article><p title='a > b' data-x=\"class='sidebar'\">{LONG}</p><p title=\"it's\">two</p></article>", f"{LONG}\ntwo"),
    "around the whole": (f"<body><div class=menu><a href=x>home</a></div><div id='content' class='sidebar-left'><h1>T</h1>{f'<p>{LONG}</p>' * 4}</div></body>", "\n".join(["T", *[LONG] * 4])),
    "only a bad name": (f"<body><div class='sidebar'>{f'<p>{LONG}</p>' * 4}</div><div class=menu><a href=x>home</a></div></body>", "\n".join([LONG] * 4)),
    "headings as ids": (f"<article><p>{LONG}</p><div id='legal'><p>{LONG}</p></div><div id='disclaimer'><p>Short, but text.</p></div></article>", f"{LONG}\n{LONG}\nShort, but text."),
    "other words": (f"<article><p>{LONG}</p><div class='social-history'><p>{LONG}</p></div><section class='search-results-explained'><p>{LONG}</p></section></article>", "\n".join([LONG] * 3)),
    "own header": (f"<header><p>{LONG}</p></header><article><header><h1>T</h1><p>By me, today.</p></header><p>{LONG}</p><p>{LONG}</p><footer>f</footer></article>", f"T\nBy me, today.\n{LONG}\n{LONG}"),
    "more comments than text": (f"<body><div class=post><p>{LONG}</p><p>{LONG}</p></div><div id=comments>{f'<div class=comment><p>{LONG}</p></div>' * 30}</div></body>", f"{LONG}\n{LONG}"),
    "commas in marks": (f"<body><div><div class=a><p><b>one, two, three, four, five, six, seven</b></p></div><a href=x>y</a></div><div><div><p>{'w' * 150}</p></div><a href=x>y</a></div></body>", "one, two, three, four, five, six, seven"),
    "score beats an element": (f"<body><article><p>A teaser.</p>{'<a href=x>a link of a list, long as it is</a>' * 30}</article><div class=story>{f'<p>{LONG}</p>' * 5}</div></body>", "\n".join([LONG] * 5)),
    "article of sections": (f"<article><h1>T</h1><section><p>{LONG}</p><p>{LONG}</p></section><div><div><p>deep</p></div></div><section><p>end</p></section></article>", f"T\n{LONG}\n{LONG}\ndeep\nend"),
    "form around a page": (f"<body><form><div class=menu><a href=x>home</a></div><div class=text>{f'<p>{LONG}</p>' * 3}</div><input name=q></form></body>", "\n".join([LONG] * 3)),
}


@pytest.mark.parametrize("name", ODD)
def test_odd_case(name):
    page, text = ODD[name]
    assert extract(page) == text


def generated(seed):
    """A page with planted paragraphs and planted boilerplate, of a random shape; the paragraphs."""
    rng = random.Random(seed)
    words = lambda n: " ".join("".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    sentence = lambda: f"{words(rng.randint(4, 9))}, {words(rng.randint(3, 9))}{rng.choice([', ', '; ', ' '])}{words(3)}."
    kept = []

    def paragraph():
        kept.append(" ".join(sentence() for _ in range(rng.randint(1, 4))))
        return f"<p{rng.choice(['', ' class=x', f' id={words(1)}-side', ' title=don’t', ' data-k=\"a>b\"'])}>{kept[-1]}{rng.choice(['</p>', ''])}"

    def heading():
        kept.append(words(3))
        return f"<h2 id='{rng.choice(['related', 'social', 'search'])}-{kept[-1].replace(' ', '-')}'>{kept[-1]}</h2>"

    links = lambda n: "".join(f"<li><a href='/{k}'>{words(2)}</a></li>" for k in range(n))
    junk = lambda: rng.choice([
        f"<div class='ad-box'>JUNK {words(5)}</div>", f"<aside>JUNK <p>{sentence()}</p></aside>", f"<div class='share-links'><ul>{links(3)}</ul>JUNK</div>", f"<div id='newsletter'><p>JUNK {sentence()}</p></div>",
        "<script>var JUNK = '</p>';</script>", "<style>.JUNK{}</style>", "<form><p>JUNK</p><input><button>JUNK</button></form>", f"<div role=alert>JUNK {sentence()}</div>", "<!-- JUNK <p> -->",
    ])
    def part():
        out = (heading() if rng.random() < 0.5 else "") + "".join(paragraph() + (junk() if rng.random() < 0.2 else "") for _ in range(rng.randint(1, 5)))
        tag = rng.choice(["div", "section", "div class=part", "section id=social-history"])
        return f"<{tag}>{out}</{tag.split()[0]}>" if rng.random() < 0.5 else out

    body = paragraph() + paragraph() + paragraph() + "".join(part() for _ in range(rng.randint(1, 4)))
    body = rng.choice(["<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div id=content class=sidebar-left>{}</div>", "<div class=wrap><div class=entry-content>{}</div></div>", "<main>{}</main>"]).format(body)
    head = f"<html><head><title>JUNK</title></head><body class='has-sidebar'><nav>JUNK<ul>{links(6)}</ul></nav><header><p>JUNK {sentence()}</p></header>" + (f"<div class='cookie-notice'><p>JUNK {sentence()}</p></div>" if rng.random() < 0.5 else "")
    tail = f"<div id=comments><h3>JUNK</h3>{''.join(f'<div class=comment><p>JUNK {sentence()}</p></div>' for _ in range(rng.randint(0, 12)))}</div><div class='sidebar-right'><ul>{links(9)}</ul><p>JUNK</p></div><footer>JUNK &copy; {words(4)}</footer>"
    return head + body + tail, kept


@pytest.mark.parametrize("seed", range(60))
def test_planted_paragraphs_come_out_and_no_boilerplate(seed):
    page, kept = generated(seed)
    got = extract(page)
    assert "JUNK" not in got and got.split("\n") == kept


def test_long_pages_and_clashing_columns(spark, tmp_path):
    long = "<article>" + f"<p>{LONG}</p>" * 60_000 + "</article>"
    rows = [(1, "u", long), (2, "u", None), (2, "u", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["page_id"], r["n_chars"]) for r in op6_html(spark, str(tmp_path)).collect())
    assert got == [(1, 60_000 * (len(LONG) + 1) - 1), (2, 0), (2, 0)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/empty/pages.parquet")
    assert op6_html(spark, f"{tmp_path}/empty").count() == 0
