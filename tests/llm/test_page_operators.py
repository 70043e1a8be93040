"""Operators on pages."""

import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from fitscape.llm import html_extract, queries, url_filter

DATA = "/root/testdata/sf0.001"


def plain_rule(host, path):
    best = None
    for verdict, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return best


def test_urls_and_rules():
    for url, expected in {
        None: ("", ""), "": ("", ""), "no scheme/en/": ("", ""), "http://A.Example.COM/En/7?x#y": ("a.example.com", "/En/7"), "x://h": ("h", ""), "x://h?q/r": ("h", ""), "x://h#a/b": ("h", ""), "a://b://c/d": ("b:", "//c/d"),
    }.items():
        assert url_filter.split_url(url) == expected
    by_host = {}
    for verdict, host, prefix in url_filter.RULES:
        by_host.setdefault(host, []).append((prefix, verdict))
    random.seed(1)
    for _ in range(500):
        host = ".".join(random.choices(["a", "example", "com", "net", "org"], k=random.randint(1, 4)))
        path = random.choice(["", "/", "/en/", "/en/7", "/en/70/x", "/de/8", "/de/1", "/es/", "/EN/"])
        assert url_filter.matching_rule(host, path, by_host) == plain_rule(host, path)


def test_segmenter():
    s = url_filter.Segmenter({"casino": 5, "win": 5, "free": 9, "bets": 4, "casinos": 1})
    assert s.words("freecasinowin") == ("free", "casino", "win") and s.words("qzx") == ("qzx",) and s.words("") == ()


def test_url_filter(spark):
    found = queries.op1_url_filter(spark, DATA).collect()
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(found) == len(pages)
    for r in found:
        host, path = url_filter.split_url(pages[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0])
        if rule:
            assert r["verdict"] == rule[1]
        elif any(w in host for w in ("casino", "spam", "adult", "bets", "pills")):
            assert r["verdict"] == "block"
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "http://www.casino-win.example.org/a"), (4, "http://good.example.org/a"), (4, "http://good.example.org/a"), (5, "http://spamfarm.example.org/")], "page_id long, url string").withColumn("host", F.lit(1))
    model = url_filter.train_url_model(odd)
    got = [(r["page_id"], r["verdict"]) for r in url_filter.filter_urls(odd, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "allow"), (2, "allow"), (None, "block"), (4, "allow"), (4, "allow"), (5, "block")], key=repr)
    assert url_filter.filter_urls(odd.limit(0), url_filter.train_url_model(odd.limit(0))).count() == 0


def test_words_beside_seeds_block_without_them(spark):
    hosts = ["casino-win", "free-bets", "casino-lucky", "poker-win", "cheap-pills"] * 8 + ["green-garden", "city-news", "open-library", "river-walks", "green-news"] * 40
    model = url_filter.train_url_model(spark.createDataFrame([(k, f"http://{h}.example/{k}") for k, h in enumerate(hosts)], "page_id long, url string"))
    new = spark.createDataFrame([(1, "http://win-lucky.example/1"), (2, "http://freewin.example/"), (3, "http://city-garden.example/2"), (4, "http://" + "x" * 200_000 + ".example/")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(new, model).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_extraction_of_given_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    found = queries.op10_html_extract(spark, DATA).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>|</?b>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", article))
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


MODEL = html_extract.train_tree_model()


@pytest.mark.parametrize(
    "source,expected",
    [
        ("", ""), ("<", ""), ("<p", ""), ("<!-- x", ""),
        ("<article><h1>T &amp; &#233;&lt;</h1><p>a <b>b</b>\n c<br>d</p><p>e<p>f</article>", "T & é<\n\na b c d\n\ne\n\nf"),
        ("<article><p>x<script>if(a<b)'</p>'</script>y</p></article>", "xy"),
        ("<nav><ul><li><a href=a>A</a></li></ul></nav><article><p>t</p><div class='ad'>no</div><form><p>f</p></form><p>u</p></article><footer><p>z</p></footer>", "t\n\nu"),
        ("<header><h1>Site</h1></header><main><h1>H</h1><ul><li>one<li>two</ul></main><aside><p>s</p></aside>", "H\n\none\n\ntwo"),
        ("<article><p>t</p></article><section class='comments'><article><p>reader</p></article></section><div class='cookie-notice'>n</div>", "t"),
        ('<article><p title="a > b">t</p><p>open <a href="x">link</a> end', "t\n\nopen link end"),
    ],
)
def test_extraction(source, expected):
    assert html_extract.main_text(source, MODEL) == expected


@pytest.mark.parametrize(
    "source,expected",
    [
        ("<article><h1>H</h1><div><div><p>a</p></div></div></article>", "H\n\na"),
        ("<div><p>Story here.</p></div>", "Story here."),
        ("<body><div id='x12'><h1>T</h1><p>One long paragraph of a story that goes on.</p></div></body>", "T\n\nOne long paragraph of a story that goes on."),
        ("no tags at all", "no tags at all"), ("a<br>b", "a b"), ("&amp; <b>x</b>", "& x"),
        ("<div class='article'><p>A<span class='ad'>Buy</span>B</p></div>", "AB"),
        ("<body><a href=x>Home</a> | <a href=y>News</a><article><p>t</p></article></body>", "t"),
    ],
)
def test_ordinary_pages(source, expected):
    assert html_extract.main_text(source, MODEL) == expected


#: M is main text, X isn't; none is among the labelled pages.
TEMPLATES = [
    "<html><body><div id=wrap><div id=inner><h1>M</h1><p>M</p><p>M</p></div></div><div id=foot><a href=a>X</a><a href=b>X</a></div></body></html>",
    "<body><div class='nav'><a href=a>X</a></div><h1>M</h1><p>M</p><div><p>M</p></div><div class='footer'>X</div></body>",
    "<table><tr><td><a href=a>X</a><br><a href=b>X</a></td><td><h2>M</h2><p>M</p><p>M</p></td></tr></table>",
    "<main><section><h2>M</h2><p>M</p></section><section><h2>M</h2><div><div><div><p>M</p></div></div></div></section></main><footer>X</footer>",
    "<div><div><div><div>M</div><div>M</div></div></div></div><div class='sidebar'><p>X</p></div>",
    "<header><p>X</p></header><div><article><p>M<span class='sponsor'>X</span></p><ol><li>M</li><li>M</li></ol></article></div><div id='comments'><p>X</p></div>",
    "<body>M<br>M<p>M</p><footer>X</footer></body>",
    "<div class='story'><h1>M</h1><p>M</p><blockquote>M</blockquote><div class='promo'><p>X</p></div><p>M</p></div><form><p>X</p></form>",
    "<body><ul><li><a href=a>X</a></li><li><a href=b>X</a></li></ul><div><h1>M</h1><pre>M</pre><dl><dt>M</dt><dd>M</dd></dl></div></body>",
    "<section><h1>M</h1><div><p>M</p><p>M</p></div></section><aside><div><p>X</p></div></aside><div class='cookie'>X</div>",
]


def test_words_of_generated_pages():
    random.seed(3)
    found = main = right = 0
    for template in TEMPLATES:
        for _ in range(20):
            words = iter(range(10**6))
            fill = lambda m: " ".join(f"{m[0].lower()}{next(words)}" for _ in range(random.choice([2, 3, 12, 40]) if m[0] == "M" else random.choice([1, 2, 6])))  # noqa: E731, B023
            source = re.sub(r"\b[MX]\b", fill, template)
            expected = set(re.findall(r"\bm\d+", source))
            got = html_extract.main_text(source, MODEL).split()
            assert len(got) == len(set(got))
            found, main, right = found + len(got), main + len(expected), right + len(expected & set(got))
    assert right >= 0.95 * main and right >= 0.95 * found, (right / main, right / found)


def test_marginals_are_exact():
    """Messages give what the sum over all labellings gives."""
    import itertools

    page = html_extract.parse("<article><p>a</p><div class='ad'>b</div></article><footer>c</footer>")
    n = len(page.tags)
    total, on = 0.0, [0.0] * n
    for labels in itertools.product((0, 1), repeat=n):
        w = 1.0
        for i, y in enumerate(labels):
            w *= MODEL._own(page, i)[y]
            if i:
                w *= MODEL.edge[html_extract._kind(page, page.parents[i])][labels[page.parents[i]]][y]
        total += w
        for i, y in enumerate(labels):
            on[i] += w * y
    assert MODEL.marginals(page) == pytest.approx([x / total for x in on])


def test_deep_pages_take_time_in_proportion():
    source = "<article><p>kept" + "<b>" * 60_000 + "x" + "</i>" * 60_000 + "<p>" * 2000 + "y</article>"
    start = time.process_time()
    assert [t for _, t in html_extract.parse(source).blocks] == ["kept" + "x", "y"]
    assert time.process_time() - start < 5


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>x</p></article>"), (2, "u", ""), (2, "u", ""), (3, "u", "<article><p>" + "w " * 50_000 + "</article>")], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = sorted(((r["page_id"], r["url"], r["n_chars"]) for r in html_extract.extract(df, MODEL).collect()), key=repr)
    assert got == sorted([(1, None, 0), (None, "u", 1), (2, "u", 0), (2, "u", 0), (3, "u", 99_999)], key=repr)
    assert html_extract.extract(df.limit(0), MODEL).count() == 0


def test_no_word_count_is_cut(spark, monkeypatch):
    urls = [f"http://{w}.example/{w}/{'casino' if i % 3 == 0 else 'good'}/x{'abcdefghij'[i % 10]}" for i, w in enumerate(["alpha", "bravo", "delta", "gamma", "omega", "sigma", "theta", "kappa"] * 6)]
    urls += [f"http://h.example/rare{'abcdefghij'[k]}word/casino" for k in range(10)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = url_filter.train_url_model(pages)
    whole = {r["page_id"]: (r["verdict"], r["words"], r["log_odds"]) for r in url_filter.filter_urls(pages, model).collect()}
    # the head that is broadcast may be small: the same split, and the same odds
    monkeypatch.setattr(url_filter, "most_frequent", lambda df, n, limit: df.filter(F.col(n) >= 9))
    small = url_filter.train_url_model(pages)
    assert small.rest is not None and small.rest.count() and len(small.block) < len(model.block)
    got = {r["page_id"]: (r["verdict"], r["words"], r["log_odds"]) for r in url_filter.filter_urls(pages, small).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in whole.items()}
    assert all(got[k][2] == pytest.approx(whole[k][2]) for k in whole)


def test_unigrams_and_labels_beyond_the_vocabulary_count(spark, monkeypatch):
    """With few words in each task, splits, labels, odds and verdicts are those of the whole vocabulary."""
    letters = "abcdefghij"
    urls = [f"http://h.example/{w}/{'casino' if i % 4 == 0 else 'good'}" for i, w in enumerate(["alpha", "bravo", "delta", "gamma"] * 12)]
    rare = [f"qu{a}zy{b}" for a in letters for b in letters[:4]]
    urls += [f"http://h.example/{w}/{'casino' if k % 2 else 'good'}" for k, w in enumerate(rare)]
    urls += [f"http://{rare[k]}{rare[(7 * k + 1) % 40]}alpha.example/{rare[k]}" for k in range(40)]  # split by rare unigrams, labelled by rare words
    urls += [f"http://{rare[1]}{rare[3]}.example/", f"http://{rare[0]}{rare[2]}.example/", None, "", "http://" + "x" * 9000 + rare[5] + ".example/x" + rare[5]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    get = lambda m: {r["page_id"]: (r["verdict"], r["words"], r["log_odds"]) for r in url_filter.filter_urls(pages, m).collect()}
    model = url_filter.train_url_model(pages)
    whole = get(model)
    assert whole[88][1][:2] == [rare[0], rare[1]] and {v[0] for v in whole.values()} == {"allow", "block"}
    monkeypatch.setattr(url_filter, "VOCABULARY", 5)
    monkeypatch.setattr(url_filter, "BEGINS", 100)
    small = url_filter.train_url_model(pages)
    assert len(small.segmenter.counts) < 50 and small.segmenter.total == model.segmenter.total and small.prior == model.prior
    got = get(small)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in whole.items()}
    assert all(got[k][2] == pytest.approx(whole[k][2]) for k in whole)
