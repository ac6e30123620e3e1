"""Main text against hand-made pages and the template of the test tables; repeated words against brute force."""

import random
import re
from html import unescape

import numpy as np

from seqlab.llm.html_extraction import _opened, _spread_out, _squeezed, main_text, page_packets, repeated_words, suffix_array
from seqlab.llm.page_blocks import ARTICLE, BOILERPLATE, UNDECIDED, page_blocks

SCHEMA = "page_id long, url string, html string"


def test_suffix_array_equals_sorting():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 60, 300):
        x = np.concatenate([rng.integers(0, 2, n), [-1]])
        order, common = suffix_array(x)
        plain = sorted(range(len(x)), key=lambda i: x[i:].tolist())
        assert order.tolist() == plain
        for a, b, c in zip(plain, plain[1:], common[1:]):
            k = 0
            while max(a, b) + k < len(x) and x[a + k] == x[b + k]:
                k += 1
            assert k == c


def test_packed_keys_come_back():
    rng = np.random.default_rng(6)
    for n, bits in ((1, 47), (2, 3), (8, 3), (500, 47), (5000, 47), (700, 61)):
        keys = np.sort(rng.choice(8, n, replace=False) if bits == 3 else rng.integers(0, 1 << bits, n)).astype(np.uint64)
        packed = _squeezed(keys, bits)
        assert _spread_out(packed, n, bits).tolist() == keys.tolist()
        assert n < 500 or len(packed) * 8 < n * (bits - np.log2(n) + 3)


def test_blocks():
    assert page_blocks("") == [] and page_blocks("<") == [("<", UNDECIDED)]
    assert page_blocks("a < b &amp;&nbsp;c<br>d&#x41") == [("a < b & c dA", UNDECIDED)]
    assert page_blocks("<article><header><h1>T</h1></header><p>one <b>two<p>three<footer>by me</footer></article>out") == [
        ("T", ARTICLE), ("one two", ARTICLE), ("three", ARTICLE), ("by me", BOILERPLATE), ("out", UNDECIDED)]
    assert page_blocks("<main><div class='comments'><p>x</div><form><p>y</form><aside>z</aside><p hidden>h</p>t</main>") == [
        ("x", BOILERPLATE), ("y", BOILERPLATE), ("z", BOILERPLATE), ("h", BOILERPLATE), ("t", ARTICLE)]
    assert page_blocks('<script>var a="</p>"; if (a<b) x</script><style>p{}</style><!-- <p>no --><p>yes<!-- cut') == [("yes", UNDECIDED)]
    assert page_blocks("<nav>menu<article>text</article>") == [("menu", BOILERPLATE), ("text", ARTICLE)]
    assert page_blocks("<form><main>text</main></form><footer><article>no</article></footer>") == [("text", ARTICLE), ("no", BOILERPLATE)]
    assert page_blocks('<p>a<p>b</p></p><a href="x') == [("a", UNDECIDED), ("b", UNDECIDED)]
    assert page_blocks("<script>never ends <p>a") == []
    assert page_blocks("<body class='no-sidebar'><div class='has-sidebar wrap'><p>t</div>") == [("t", UNDECIDED)]
    assert len(page_blocks("<div>" * 3000 + "deep")) == 1


def template_text(html):
    """The main text of the test tables' pages, by their one template."""
    inside = html[html.index("<article>") + 9:html.index("</article>")]
    parts = re.split(r"</?(?:p|h1)>", inside)
    texts = [" ".join(unescape(re.sub(r"<b>|<br>", " " if "br" in p else "", p)).split()) for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    expected = sorted((r.page_id, r.url, template_text(r.html), len(template_text(r.html))) for r in pages.collect())
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in main_text(pages.repartition(5)).collect()) == expected


def brute_covered(rows, size):
    grams = {}
    for uid, host, words in rows:
        for i in range(len(words) - size + 1):
            grams.setdefault((host, *words[i:i + size]), set()).add(uid)
    out = {}
    for uid, host, words in rows:
        covered = [False] * len(words)
        for i in range(len(words) - size + 1):
            if len(grams[(host, *words[i:i + size])]) > 1:
                covered[i:i + size] = [True] * size
        out[uid] = covered
    return out


def test_repeated_words_equal_brute_force_whatever_the_chunks(spark):
    rng = random.Random(1)
    menus = [" ".join(rng.choice("abcdef") for _ in range(12)) for _ in range(4)]
    rows = []
    for i in range(150):
        host = "hot" if i % 3 else f"h{i % 7}"
        body = " ".join(rng.choice("uvwxyz") + str(rng.randrange(4)) for _ in range(rng.randrange(30)))
        rows.append((i, f"http://{host}/x", f"<div>{rng.choice(menus)}</div><div>{body}</div>"))
    packets = page_packets(spark.createDataFrame(rows, SCHEMA).repartition(4))
    facts = [(r["uid"], r["host"], r["text"].split()) for p in packets.collect() for r in _opened(p.outside).to_pylist()]
    expected = brute_covered(facts, 6)
    assert sum(map(sum, expected.values())) > 500
    for chunk_words in (1, 300, 1 << 20):
        assert {r.uid: r.covered for r in repeated_words(packets, 6, chunk_words).collect()} == expected


def test_pages_without_article_elements(spark):
    """Boilerplate goes by repetition alone, the unique rest stays; the same text on another host stays."""
    prose = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    notice = "please accept these seven little words here now"
    page = lambda i: f"<div>Home News Sport Weather Travel Shop About</div><div>{prose(i)}</div><div>{notice}</div>"
    rows = [(i, "https://one.example/a", page(i)) for i in range(5)] + [(9, "https://two.example/", page(9))]
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(5):
        assert got[i].text == prose(i) and got[i].n_repeated == 15 and got[i].n_blocks == 3
    assert got[9].text == "\n\n".join(["Home News Sport Weather Travel Shop About", prose(9), notice])
    copies = [(i, "https://one.example/", page(1)) for i in range(3)]  # nothing unique: long blocks stay
    assert {r.text for r in main_text(spark.createDataFrame(copies, SCHEMA)).collect()} == {prose(1)}


def test_small_cases(spark):
    same = "<article><p>copied text of the article that repeats on every page</p></article>"
    rows = [(1, None, None), (1, "http://a/", ""), (None, "http://a/", same), (2, "http://a/", same), (2, "http://a/", same), (3, "not a url", "plain &lt;text&gt;"),
            (4, "http://a/", "<article>" + "<p>long word</p>" * 20000 + "</article>")]
    pages = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as text", "2 as uid", "3 as host", "4 as blocks", "5 as covered", "6 as packet")
    got = main_text(pages).collect()
    assert len(got) == len(rows)
    article = "copied text of the article that repeats on every page"
    assert sorted((str(r.page_id), r.text) for r in got if r.n_chars < 100) == sorted([("1", ""), ("1", ""), ("None", article), ("2", article), ("2", article), ("3", "plain <text>")])
    assert max(r.n_chars for r in got) == 20000 * 11 - 2
    assert main_text(pages.limit(0)).collect() == []


def test_words_of_articles_enter_the_suffix_arrays(spark):
    """Repeats inside articles are found as brute force finds them; a repeat does not cross the bounds of an article."""
    rng = random.Random(2)
    shared = [" ".join(rng.choice("abcdef") for _ in range(14)) for _ in range(5)]
    body = lambda: " ".join(rng.choice("uvwxyz") + str(rng.randrange(4)) for _ in range(rng.randrange(30)))
    rows = [(i, f"http://{'hot' if i % 3 else f'h{i % 7}'}/x", f"<nav>{rng.choice(shared)}</nav><article><p>{body()}</p><p>{rng.choice(shared)}</p></article><div>{body()}</div>")
            for i in range(120)]
    packets = page_packets(spark.createDataFrame(rows, SCHEMA).repartition(4))
    facts, layout = [], {}
    for p in packets.collect():
        for around, within in zip(_opened(p.outside).to_pylist(), _opened(p.pages).to_pylist()):
            streams = [around["text"].split(), within["text"].split()]
            layout[around["uid"]] = [len(s) for s in streams]
            facts += [(around["uid"], around["host"], s) for s in streams]
    grams = {}
    for uid, host, words in facts:
        for i in range(len(words) - 5):
            grams.setdefault((host, *words[i:i + 6]), set()).add(uid)
    expected, inside = {}, 0
    for k, (uid, host, words) in enumerate(facts):
        covered = [False] * len(words)
        for i in range(len(words) - 5):
            if len(grams[(host, *words[i:i + 6])]) > 1:
                covered[i:i + 6] = [True] * 6
        expected[uid] = expected.get(uid, []) + covered
        inside += sum(covered) if k % 2 else 0
    assert inside > 500
    for chunk_words in (1, 300, 1 << 20):
        assert {r.uid: r.covered for r in repeated_words(packets, 6, chunk_words).collect()} == expected


def test_template_inside_articles(spark):
    """What the host shows as boilerplate elsewhere goes from articles where no text element holds it; repeated text stays."""
    prose = lambda i: " ".join(f"word{i}x{j}" for j in range(40))
    notice, passage = "please accept these seven little words here now", "a passage that many articles of the host share in full"
    page = lambda i, tag: f"<article><h1>Title {i}</h1><{tag}>{notice}</{tag}><p>{prose(i)}</p><div>{passage}</div></article>"
    aside = f"<aside>{notice}</aside><article><p>{prose(0)}</p></article>"
    rows = [(0, "https://one.example/", aside)] + [(i, "https://one.example/", page(i, "div")) for i in (1, 2)] + [(3, "https://one.example/", page(3, "p"))]
    rows += [(i, "https://two.example/", page(i, "div")) for i in (4, 5)]  # no boilerplate tells of it
    rows += [(6, "https://three.example/", aside), (7, "https://three.example/", page(7, "div"))]  # one article alone
    got = {r.page_id: r for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    for i in range(1, 8):
        if i != 6:
            kept = [] if i in (1, 2) else [notice]
            assert got[i].text == "\n\n".join([f"Title {i}", *kept, prose(i), passage])
    assert got[1].n_repeated == 19 and got[3].n_repeated == 19 and got[7].n_repeated == 8 and got[0].n_repeated == 8
    only = [(i, "https://one.example/", f"<aside>{notice}</aside><main>{notice}</main>") for i in range(2)]
    assert {r.text for r in main_text(spark.createDataFrame(only, SCHEMA)).collect()} == {notice}
