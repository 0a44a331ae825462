"""Names of elements choose among what varies on a host; they do not decide over the page."""

import pytest

from tidepanel.llm import html_extract, page_tree

KIND = "page_id long, url string, html string"


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, KIND)).collect()}


def test_names_of_the_whole_page_do_not_empty_it(spark):
    pages = [
        "<body class='no-sidebar'><p>story {}</p></body>",
        "<div id='content' class='with-sidebar'><p>story {}</p></div>",
        "<body><main class='search'><p>story {}</p></main></body>",
        "<body class='sidebar'><article class='share'><p>story {}</p></article></body>",
        "<div class='widget'><p>story {}</p></div>",
        "<form><nav>menu {}</nav><p>story {}</p></form>",
    ]
    rows = [(10 * k + i, f"http://h{k}.org/{i}", page.format(i, i)) for k, page in enumerate(pages) for i in range(3)]
    assert extracted(spark, rows) == {10 * k + i: f"story {i}" for k in range(len(pages)) for i in range(3)}


def test_text_outside_a_teaser_is_kept(spark):
    page = "<main><div><p>" + "long story {} " * 20 + "</p></div><article><p>teaser {}</p></article></main>"
    got = extracted(spark, [(i, f"http://h.org/{i}", page.format(*[i] * 21)) for i in range(3)])
    assert all(got[i].startswith(f"long story {i}") for i in range(3))


def test_alignment_decides_from_two_pages_on(spark):
    page = "<div><h2>Our site</h2><div class='text'><p>story {0}</p><p>more of {0}</p></div><p>Call us</p></div>"
    got = extracted(spark, [(i, f"http://h.org/{i}", page.format("abc"[i] * 30)) for i in range(2)])
    assert got == {i: f"story {'abc'[i] * 30} more of {'abc'[i] * 30}" for i in range(2)}


def test_copies_on_a_small_host_keep_their_text(spark):
    text = "<p>the same long story told again</p>"
    rows = [(i, f"http://h.org/{i}", f"<nav>menu {i}</nav><article>{text}</article>") for i in range(2)]
    rows += [(10 + i, f"http://g.org/{i}", f"<nav>menu {i}</nav><article>{text}<p>end {i}</p></article>") for i in range(2)]
    got = extracted(spark, rows)
    assert got[0] == got[1] == "the same long story told again"
    assert got[10] == "the same long story told again end 0" and got[11] == "the same long story told again end 1"


def test_an_empty_article_stays_empty():
    page = page_tree.parse("<nav>menu</nav><div class='ad'>buy</div><article></article><footer>foot</footer>")
    assert page.blocks == [] and page_tree.choose(page.texts, set()) == []


@pytest.mark.parametrize("name", ["comment-list", "site-footer", "ad", "sidebar-left", "ad_slot_3"])
def test_names_outside(name):
    assert page_tree._outside(name)


@pytest.mark.parametrize("name", ["no-sidebar", "with-sidebar", "share-price", "search-results", "content", "item-list", "adage"])
def test_names_not_outside(name):
    assert not page_tree._outside(name)
