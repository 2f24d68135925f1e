from epochlens.llm import html

TREE = html.trained()


def test_the_tree_fits_its_table_and_uses_neighbours():
    import numpy as np

    table = np.array(html.LABELLED, float)
    assert (html.classify(TREE, table[:, :-1]) == table[:, -1]).mean() > 0.95
    used = set()

    def walk(node):
        if isinstance(node, html.Split):
            used.add(html.FEATURES[node.feature])
            walk(node.low)
            walk(node.high)

    walk(TREE)
    assert {"links", "words"} <= used and used & {"links_before", "links_after", "words_before", "words_after"}


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href=/>Home</a> Our site</header>
    <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav><div id="cookie-notice"><p>We use cookies to make this site better for all of you.</p></div>
    <div class="content"><h1>Title &amp;  more</h1><p>First   paragraph&nbsp;of the<br>article, <b>long</b> enough.<p>Short.<script>var t="</p>";</script>
    <p>See <a href=z>this link</a> for more on it.</p><ul><li>first point here<li>second point</ul><!-- <p>hidden</p> --></div>
    <form><label>Mail</label><input><button>Go</button></form><aside><p>Related things that you may like to read today</p></aside>
    <div class="user-comments"><h2>Comments</h2><p>This is a very good article indeed, thanks for all of it</p></div><footer>&copy; 2020</footer></body></html>"""
    assert html.main_text(page, TREE).split("\n") == [
        "Title & more", "First paragraph of the article, long enough.", "Short.", "See this link for more on it.", "first point here", "second point"
    ]


def test_odd_pages(spark):
    long = "<article>" + "<p>some words in a paragraph &lt;3</p>" * 5000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "plain words"), (None, "u", "<p>a<p>b"), (5, "u", "<nav><a>x</a></nav><div class=ad>buy</div>"), (6, "u", long),
            (7, "u", "<p>un<b>closed <i>tags"), (7, "u", "<p>un<b>closed <i>tags"), (8, "u", "</div></p><p>x < y & z</p><"), (9, "u", "<!-- never ends <p>x</p>")]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].text == got[2].text == got[5].text == got[9].text == ""
    assert got[3].text == "plain words" and got[None].text == "a\nb" and got[7].text == "unclosed tags" and got[8].text == "x < y & z\n<"
    assert got[6].text == "\n".join(["some words in a paragraph <3"] * 5000) and got[6].n_chars == len(got[6].text)
    assert html.extract(pages).count() == 10 and html.extract(pages.limit(0)).count() == 0


def test_no_page_text_is_cut():
    text = "<p>The main text of this page stands here and is long enough.</p>"
    want = "The main text of this page stands here and is long enough."
    for page in (
        f"<head><title>T</title><body>{text}", f"<head><title>T</title><meta charset=utf-8>{text}", f"<svg/>{text}", f"<canvas/>{text}", f"<iframe src='x'/>{text}",
        f"<select><option>{text}", f"<svg>{text}", f"<select>{text}<select></select>", f"<script>var a = 1;{text}", f"<textarea>{text}",
        f'<div class="overflow-hidden">{text}</div>', f'<div aria-hidden="false">{text}</div>', f'<div hidden="until-found">{text}</div>', f'<div data-x="display: none">{text}</div>',
        f'<div class="content no-sidebar">{text}</div>', f'<div class="has-comments">{text}</div>', f'<script>var a = "<article>";</script>{text}', f"<template><main></main></template>{text}",
    ):
        assert html.main_text(page, TREE).split("\n")[-1] == want, page
    for page in (f"<div hidden>{text}</div>", f'<div style="color:red; display:none">{text}</div>', f"<div aria-hidden=true>{text}</div>", f"<script>{text}</script>", f"<select><option>x</select><div class=sidebar>{text}</div>"):
        assert html.main_text(page, TREE) == "", page


def test_words_and_links_decide_on_long_blocks():
    long = " ".join(f"word{i}" for i in range(160))
    assert html.main_text(f'<div class="sidebar"><p>{long}</p><p>{long}</p></div>', TREE) == f"{long}\n{long}"
    assert html.main_text(f"<article><p>A short teaser stands in here today.</p></article><div><p>{long}</p></div>", TREE).endswith(long)
    linked = "".join(f"<a href=x>word{i}</a> " for i in range(160))
    assert html.main_text(f"<div class=sidebar><p>{linked}</p></div>", TREE) == ""


def test_quotation_marks_in_tags():
    text = "The main text of this page stands here and is long enough."
    for tag in ("<p title=it's>", '<p title=5">', "<p it's>", '<p title="a > b">', "<p title = 'a > b'>", "<p a=b c='>' d>", '<p data-x="it\'s">'):
        assert html.main_text(f"{tag}{text}</p><p>And it's \"more\" text that follows it.</p>", TREE).split("\n")[0] == text, tag
    assert html.main_text("<p " + "a='b' " * 5000, TREE).startswith("<p a='b'")


def test_heads_and_links_of_an_article_stay():
    prose = "A paragraph of the article with a good number of words that stands around the others in it."
    page = f"""<div class="site-header">The site</div><article><div class="entry-header"><h1>Its own head line</h1></div><p>{prose}</p>
    <p><a href=x>The whole report on this matter</a></p><p>{prose}</p><ul><li>{prose}<li><a href=y>A point that is a link</a><li>{prose}</ul>
    <ul class=related><li><a href=z>Another story</a><li><a href=w>One more story</a></ul></article>"""
    assert html.main_text(page, TREE).split("\n") == ["Its own head line", prose, "The whole report on this matter", prose, prose, "A point that is a link", prose]
