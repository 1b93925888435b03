import html
import re

import pytest

from ledgerlake.llm import common
from ledgerlake.llm import op1_html as op

PAGES = "page_id long, url string, html string, host string, part int"


def expected(source):
    """The article by plain pattern matching: the fixture's pages have no other boilerplate inside it."""
    m = re.search(r"(?s)<article>(.*?)(?:</article>|$)", source or "")
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", m[1])) if m else []
    return "\n\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", html.unescape(b)).strip()))


def test_fixture(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r["page_id"]: r for r in op.main_texts(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == expected(r["html"]) and got[r["page_id"]]["n_chars"] == len(expected(r["html"]))


def site(n, article):
    return f"""<html><head><title>t{n}</title></head><body class="page"><header>Site name</header>
    <div class="top-menu"><a href="/">Home</a> <a href="/x">News</a></div>
    <div id="content">{article}</div>
    <div class="cookie-notice">We use cookies</div><aside>Other {n}</aside>
    <section class="comments"><p>First! {n}</p></section><form><label>Mail</label></form>
    <div><p>All rights reserved by us</p></div><footer>Foot</footer></body>"""


def extract(spark, sources, host="h.example"):
    rows = [(n, f"https://{host}/{n}", source, "h", 1) for n, source in enumerate(sources)]
    return [r["text"] for r in op.main_texts(spark.createDataFrame(rows, PAGES)).orderBy("page_id").collect()]


def filler(n, k=3):
    return "".join(f"<p>Paragraph {i} of page {n} says {n * 31 + i} things.</p>" for i in range(k))


def filled(n, k=3):
    return "\n\n".join(f"Paragraph {i} of page {n} says {n * 31 + i} things." for i in range(k))


def test_without_article_the_densest_slots_are_text_and_the_frame_is_not(spark):
    texts = [f"<h2>Title {n}</h2><p>Some words of page {n} &amp; more&nbsp;of it, number {n * 7}.<p>Next <b>bo</b>ld<br>line {n}</p>" for n in range(6)]
    got = extract(spark, [site(n, t) for n, t in enumerate(texts)])
    for n, text in enumerate(got):
        assert text == f"Title {n}\n\nSome words of page {n} & more of it, number {n * 7}.\n\nNext bold line {n}"
        assert not any(w in text for w in ("cookies", "Home", "First!", "Foot", "Mail", "Other", "Site name", "rights"))


def test_the_template_within_articles_goes_and_classes_decide_it(spark, monkeypatch):
    letter = "<p>Sign up for our letter, it comes every week.</p>"
    pages = [site(n, f"<article><h1>Title {n}</h1>{filler(n)}{letter}<div class='ad'>Buy</div></article>") for n in range(20)]
    assert extract(spark, pages) == [f"Title {n}\n\n{filled(n)}" for n in range(20)]
    few = pages[: op.SUPPORT - 1]
    assert all(t.endswith("every week.") for t in extract(spark, few))
    monkeypatch.setattr(op, "templates", lambda rows: spark.createDataFrame([], op.TEMPLATE))
    assert all(t.endswith("every week.") for t in extract(spark, pages))


def test_text_that_is_no_template_stays(spark):
    # on most pages, but not whenever the article is there; and twice on a page, once on others
    often = "<p>Read what others wrote about it.</p>"
    pages = [site(n, f"<article>{filler(n)}{often * (0 if n == 3 else 2 if n == 5 else 1)}</article>") for n in range(12)]
    got = extract(spark, pages)
    assert [t.count("Read what") for t in got] == [0 if n == 3 else 2 if n == 5 else 1 for n in range(12)]
    # not in one order
    a, b = "<p>One note of the house.</p>", "<p>Another note of the house.</p>"
    got = extract(spark, [site(n, f"<article>{a + b if n % 2 else b + a}{filler(n, 5)}</article>") for n in range(12)])
    assert all("One note" in t and "Another note" in t for t in got)


def test_two_layouts_of_a_host(spark):
    one = [f"<html><body><div><div>{filler(n)}</div></div><div class='x'>All rights are ours</div></body></html>" for n in range(6)]
    two = [f"<html><body><table><tr><td>{filler(n)}</td></tr></table><div class='x'>All rights are ours</div></body></html>" for n in range(6, 8)]
    assert extract(spark, one + two) == [filled(n) for n in range(8)]


def test_articles_within_articles_are_comments(spark):
    source = lambda n: f"<article><h1>Title {n}</h1>{filler(n)}<article><h2>Readers say</h2><p>I disagree, {n}</p></article><p>End {n}.</p></article>"
    assert extract(spark, [site(n, source(n)) for n in range(5)]) == [f"Title {n}\n\n{filled(n)}\n\nEnd {n}." for n in range(5)]
    assert extract(spark, [site(0, source(0))]) == [f"Title 0\n\n{filled(0)}\n\nEnd 0."]


def test_references_are_decoded_piece_by_piece(spark):
    assert extract(spark, ["<article>a &am<b>p;</b> b &amp;lt; &#233;</article>"]) == ["a &amp; b &lt; \u00e9"]


def test_occurrence_vectors_tell_classes(spark):
    pages = [site(n, "<ul>" + "<li>x</li>" * (n + 1) + f"</ul>{filler(n)}") for n in range(5)]
    rows = op.sites(spark.createDataFrame([(n, "https://h.example/", s, "h", 1) for n, s in enumerate(pages)], PAGES))
    found = {r["t"]: r for r in op.templates(rows).collect()}
    content = "/html/body/div.content"
    of = lambda path: (found[op.token_of(path)]["x"], found[op.token_of(path)]["y"])
    assert of("/html/body") == of(content) == of(f"{content}/ul") != of(f"{content}/ul/li")
    assert of(f"{content}/p") != of(f"{content}/ul/li")
    # "x" stands whenever its item does, so it is the template's and the item holds nothing
    x = found[op.token_of(f"{content}/ul/li", "x")]
    assert x["mean"] is None and (x["x"], x["y"]) == of(f"{content}/ul/li") and found[op.token_of(f"{content}/ul")]["mean"] == 0
    assert found[op.token_of(content)]["mean"] == found[op.token_of(f"{content}/p")]["mean"] > 50


def test_odd_pages(spark):
    odd = [None, "", "plain words", "<p>1 < 2 &lt; 3", "<article>open <b>never closed", "<script>if (a < b) '</p>'</script><article><p>x</article>", "<!-- <article>no</article> --><article>yes</article>", "a" * 300_000, "<div " * 2000, "<div>" * 3000 + "deep"]
    got = extract(spark, odd)
    assert got[:3] == ["", "", "plain words"] and got[3] == "1 < 2 < 3" and got[4] == "open never closed" and got[5] == "x" and got[6] == "yes" and got[7] == odd[7] and got[9] == "deep"


@pytest.mark.parametrize("sent", [True, False])
def test_large_hosts_nulls_and_repeats(spark, monkeypatch, sent):
    monkeypatch.setattr(op, "GROUP", 8)
    if not sent:
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(common.join_checked, "__defaults__", ("left", 0))
    letter = "<p>Sign up for our letter, it comes every week.</p>"
    rows = [(n, f"https://one.example/{n}", site(n, f"<article>{filler(n)}{letter}</article>"), "h", 1) for n in range(60)]
    rows += [(60, None, site(60, "<article>text 60</article>"), "h", 1), (61, "no url", None, None, None), (None, None, None, None, None), rows[0]]
    got = op.main_texts(spark.createDataFrame(rows, PAGES)).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == ("text 60" if r["page_id"] == 60 else filled(r["page_id"])) for r in got if r["page_id"] is not None and r["page_id"] < 61)


def test_empty(spark):
    assert op.main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_copies_of_a_page_keep_their_text(spark):
    text = lambda n: f"<h2>Title{n}</h2><p>Every{n} word{n} stands{n} here{n} once{n}.</p><p>More{n} of{n} it{n}.</p>"
    want = lambda n: f"Title{n}\n\nEvery{n} word{n} stands{n} here{n} once{n}.\n\nMore{n} of{n} it{n}."
    copies = [site(n, text("x")) for n in range(32)]
    assert extract(spark, copies + [site(40 + n, text(n)) for n in range(32)]) == [want("x")] * 32 + [want(n) for n in range(32)]
    assert all(want("x") in t for t in extract(spark, copies[:2]))
    # copies that differ in a word are most of what there is, and stay whole
    near = [site(n, f"<article>{filler(7, 4)}<p>Last words {n}.</p></article>") for n in range(9)]
    assert extract(spark, near) == [f"{filled(7, 4)}\n\nLast words {n}." for n in range(9)]
    words = ["one two three", "three one two", "two three one"]
    assert extract(spark, [site(n, f"<p>{w}</p>") for n, w in enumerate(words)]) == words
