"""Main text: blocks, and all of it against comparing every start with every other one."""

import random
import re
import time
from collections import defaultdict

import pytest

from labelkite.llm import html_text
from labelkite.llm.html_text import ARTICLE, FURNITURE, LOOSE

KIND = "page_id bigint, url string, html string"


@pytest.mark.parametrize(
    ("html", "article", "loose"),
    [
        ("", [], []),
        ("plain  text &amp; more", [], ["plain text & more"]),
        ("<article><h1>T</h1><p><b>One<br><p>Two <i>x</i>y</p></article><footer>f</footer>", ["T", "One", "Two xy"], []),
        ('<body><nav>n</nav><script>var t="</p>";</script><div class="ad">a</div><article><p>Text</article>', ["Text"], []),
        ('<article><p>A<div class="user-comments"><p>c</div><form>f</form><aside>s</aside><p>B', ["A", "B"], []),
        ("<article>cut &am", ["cut &am"], []),
        ("<article>cut <stro", ["cut"], []),
        ("<article>a<!-- no --> b<!-- never closed", ["a b"], []),
        ('<div title="x>y">one</div><p>two', [], ["one", "two"]),
        ("<article>post<article>reader</article></article>", ["post"], []),
        ('<header>h</header><main><p>M</main><div id="cookie-notice">c</div>', ["M"], []),
        ('<article><div class="post-header"><h1>T</h1></div><p class="legal">L<span class="ad">x</span>M</article>', ["T", "LM"], []),
    ],
)
def test_blocks(html, article, loose):
    blocks, kinds = html_text.blocks_of(html)
    assert [b for b, k in zip(blocks, kinds) if k == ARTICLE] == article
    assert [b for b, k in zip(blocks, kinds) if k == LOOSE] == loose


def test_furniture_is_indexed_too():
    assert html_text.blocks_of("<nav><a>one</a><ul><li>two</ul></nav>x<script>y</script>") == (["one", "two", "x"], [FURNITURE, FURNITURE, LOOSE])


def test_deep_pages_take_no_longer():
    begin = time.perf_counter()
    for html in ("<div>" * 50_000 + "x", "<b>" * 50_000 + "</i>" * 50_000, "<p>" + "<div>" * 50_000):
        html_text.blocks_of(html)
    assert time.perf_counter() - begin < 20  # growing with the square it would be minutes


def brute(rows, width):
    """The documented rules over every start of every page, by dictionaries."""
    contents = {}
    for _, url, html in rows:
        host = (re.match(html_text.HOST, url or "") or [None, ""])[1].lower()
        contents[host, html or ""] = html_text.blocks_of(html or "")
    seen, of_host = defaultdict(set), defaultdict(int)
    for (host, html), (blocks, _) in contents.items():
        of_host[host] += 1
        t = [x for b in blocks for x in b.split(" ")]
        for i in range(len(t) - width + 1):
            seen[host, tuple(t[i : i + width])].add(html)
    out = []
    for page, url, html in rows:
        host = (re.match(html_text.HOST, url or "") or [None, ""])[1].lower()
        blocks, kinds = contents[host, html or ""]
        words = [(x, n, k) for n, (b, k) in enumerate(zip(blocks, kinds)) for x in b.split(" ")]
        cover = [set(), set()]
        for i in range(len(words) - width + 1):
            n = len(seen[host, tuple(x for x, *_ in words[i : i + width])])
            if n >= 2 and n >= html_text.SHARE * of_host[host]:
                cover[0].update(range(i, i + width))
            if n >= html_text.SITE and n >= html_text.SITE_SHARE * of_host[host]:
                cover[1].update(range(i, i + width))
        article = [w for i, w in enumerate(words) if w[2] == ARTICLE and i not in cover[1]]
        if 2 * len(article) < sum(k == ARTICLE for *_, k in words):
            article = [w for w in words if w[2] == ARTICLE]
        loose = [w for i, w in enumerate(words) if w[2] == LOOSE and i not in cover[0]]
        kept = defaultdict(list)
        for x, n, _ in article + (loose if len(loose) > len(article) else []):
            kept[n].append(x)
        out.append((page, url, "\n".join(" ".join(kept[n]) for n in sorted(kept))))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("shard", "copies"), [(10**7, 1000), (2500, 1000), (2500, 3)])
def test_all_of_it_against_brute_force(spark, shard, copies):
    """One shard or many, copies in one shard or dealt out; pages with an article, without, with a teaser."""
    rnd = random.Random(2)
    word = lambda: rnd.choice("abcdefghijklmnop") + rnd.choice("xyz")
    text = lambda n: " ".join(word() for _ in range(n))
    menus, notices, passage = [text(9) for _ in range(3)], [text(8) for _ in range(2)], text(20)
    rows = []
    for i in range(90):
        host = f"h{i % 2}.Example"
        body = [text(rnd.randint(1, 12)) for _ in range(4)] + [notices[i % 2]] + [passage] * (rnd.random() < 0.1)
        rnd.shuffle(body)
        inner = "".join(f"<p>{b}</p>" for b in body)
        shapes = [f"<nav>{rnd.choice(menus)}</nav><article>{inner}</article>", f"<div>{rnd.choice(menus)}</div>{inner}", f"<article>{text(2)}</article>{inner}<footer>{rnd.choice(menus)}</footer>"]
        rows.append((i, f"http://{host}/{i}", shapes[i % 3 if i < 60 else 0]))
    rows += [(1000 + i, "http://h1.example/copy", rows[1][2]) for i in range(8)] + [(2000, "http://other.example/x", rows[1][2]), (2001, None, "<p>" + passage), (2002, None, None)]
    got = html_text.main_text(spark.createDataFrame(rows, KIND).repartition(3), width=5, shard=shard, copies=copies).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 5)
    site = [t for p, _, t in brute(rows, 5) if p < 90]
    assert any(notices[0] not in t for t in site[60:])  # what stands on all of a site goes, in articles too


def test_nulls_repeats_clashes_and_empty(spark):
    kind = "page_id bigint, url string, html string, text string, host string, shard int"
    rows = [(1, None, None, "x", "", 1), (None, "http://a/", "<p>one two</p>", None, "", 1), (2, "u", "<article>t</article>", "y", "", 1), (2, "u", "<article>t</article>", "y", "", 1)]
    got = html_text.main_text(spark.createDataFrame(rows, kind)).collect()
    assert sorted((r.page_id or 0, r.text) for r in got) == [(0, "one two"), (1, ""), (2, "t"), (2, "t")]
    assert html_text.main_text(spark.createDataFrame([], kind)).count() == 0


def test_copies_and_quotations_keep_their_text(spark):
    """Copies have one content, also under one id; a quotation on two pages of thirty isn't boilerplate, a notice on all is."""
    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(10_000)}" for _ in range(n))
    notice, quoted = text(15), text(12)
    bodies = [text(40) for _ in range(30)]
    bodies[3] += " " + quoted
    bodies[4] = quoted + " " + bodies[4]
    html = [f"<p>{b}</p><p>{notice}</p>" for b in bodies]
    rows = [(i, f"http://h.example/{i}", h) for i, h in enumerate(html)]
    rows += [(100 + i, f"http://h.example/copy{i}", html[i]) for i in range(10)] + [(0, "http://h.example/0", html[7])]
    got = html_text.main_text(spark.createDataFrame(rows, KIND)).collect()
    want = [(i, b) for i, b in enumerate(bodies)] + [(100 + i, bodies[i]) for i in range(10)] + [(0, bodies[7])]
    assert sorted((r.page_id, r.text) for r in got) == sorted(want)


def test_edited_copies_of_an_article_stay_whole(spark):
    rnd = random.Random(5)
    body = " ".join(f"w{rnd.randrange(10_000)}" for _ in range(60))
    rows = [(i, f"http://h.example/{i}", f"<article><p>{body} end{i}</p></article><footer>all of us here</footer>") for i in range(9)]
    got = html_text.main_text(spark.createDataFrame(rows, KIND)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"{body} end{i}") for i in range(9)]


def test_names_inside_articles():
    keep = ['<div class="notice-board">kept</div>', '<p class="social science">kept</p>', '<p>one <span class="related-work">kept</span> two</p>', '<span id="share">kept</span>', '<div class="research">kept</div>', '<p class="legal">kept</p>']
    drop = ['<div class="share-buttons">gone</div>', '<div class="social">gone</div>', '<section id="related-posts">gone</section>', '<div class="ad wide">gone</div>', '<div class="newsletter signup">gone</div>', '<ul class="comment-list">gone</ul>', "<aside>gone</aside>"]
    for x in keep:
        blocks, kinds = html_text.blocks_of(f"<article><p>text</p>{x}</article>")
        assert "kept" in " ".join(b for b, k in zip(blocks, kinds) if k == html_text.ARTICLE), x
    for x in drop:
        blocks, kinds = html_text.blocks_of(f"<article><p>text</p>{x}</article>")
        assert "gone" not in " ".join(b for b, k in zip(blocks, kinds) if k != html_text.FURNITURE), x
    blocks, kinds = html_text.blocks_of('<body><div class="notice-board">menu</div><article><p>text</p></article></body>')
    assert kinds == [html_text.FURNITURE, html_text.ARTICLE]


def test_contents_with_many_copies_count_once_in_their_home(spark):
    rows = [(i, "http://h/x", f"<p>content {i % 4} {'w ' * 40}</p>") for i in range(240)] + [(None, "http://h/x", "<p>none</p>")] * 30
    pages = spark.createDataFrame(rows, "key bigint, url string, html string")
    got = html_text.dealt(pages, 100, 20).filter("counted").select("content").distinct().count()
    assert got == 5
