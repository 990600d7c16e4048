import html
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, html_text
from tessera.llm.html_text import extract_text, main_text
from tessera.llm.queries import URL_RULES, queries
from tessera.llm.url_filter import BAD_WORDS, judge_urls, with_host_and_path, word_labels

P = "This paragraph of the article is long enough to be taken for content by its ratio of text to tags."
CASES = [
    ("", ""), (None, ""), ("   ", ""), ("<html><body></body></html>", ""), ("no markup at all", "no markup at all"),
    (f"<nav><a>Home</a></nav><article><h1>Title</h1><p>{P}</p><p>Hm.</p></article><footer>foot {P}</footer>", f"Title\n{P}\nHm."),
    (f"<article><p>One  &amp;\n two &lt;b&gt;<br>three<p><b>{P}<p>four</article>", f"One & two <b> three\n{P}\nfour"),
    (f'<main><p>{P}</p><aside>side {P} {P}</aside><div class="ad-box">ad {P}</div><form><p>{P}</p></form><p>end</p></main>', f"{P}\nend"),
    (f'<div id="content"><p>{P}</p><p>{P}</p></div><div id="sidebar"><p>{P}</p></div>', f"{P}\n{P}"),
    (f'<article><p>{P}</p><section class="comments"><p>first! {P} {P} {P}</p></section></article>', P),
    (f'<article><p>{P}</p></article><section id="comments"><article><p>{P} {P}</p></article></section>', P),
    (f'<article><script>var t="</p>";</script><style>p{{}}</style><!-- {P} --><p>{P}</p><template>x</template></article>', P),
    (f'<div class="cookie-notice">We use cookies {P} {P}</div><article><ul><li>a</li><li>b</li></ul><table><tr><td>c</td><td>d</td></tr></table><p>{P}</p></article>', f"a\nb\nc\nd\n{P}"),
    (f"<p>{P}</p></div></span><p>two <i>three</i> four</p>", f"{P}\ntwo three four"),
    ("<article>&copy; &#233; &#x1D11E; &nosuch; x&y</article>", html.unescape("&copy; &#233; &#x1D11E; &nosuch; x&y")),
    (f'<div class="content with-sidebar"><div>{P}</div><div>Hm.</div></div><div class="sidebar">{P}</div>', f"{P}\nHm."),
    (f'<article class="post"><p>{P}</p></article><article class="comment"><p>{P} {P} {P}</p></article>', P),
    (f"<body><div>Home</div><div>{P}</div></body>", P),
    ("<article><p>" + "word " * 40_000 + "</p></article>", ("word " * 40_000).strip()),
]


@pytest.mark.parametrize("page, text", CASES)
def test_main_text(page, text):
    assert main_text(page) == text


def test_pages_against_their_markup(spark, sf_dir):
    """The article of every page, taken out with regular expressions that fit these pages alone."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: (r.main_text, r.n_chars) for r in extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S).group(1)).replace("<br>", " ")
        blocks = [re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n".join(b for b in blocks if b)
        assert got[r.page_id] == (text, len(text))


def test_extract_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "<p>x", "b")], "page_id long, html string, main_text string")
    assert sorted(r.main_text for r in extract_text(df).collect()) == ["", "", "x"]
    assert extract_text(df.limit(0)).count() == 0


URLS = [
    None, "", "nothing", "http://", "HTTP://A.Example.COM/De/x", "https://x.example.org/es/1", "https://example.org/en/12", "https://notexample.org/es/1", "https://a.b.org", "https://a.b.org/", "s://h.com?u=://z/fr/", "s://h.com/fr/?q#f",
    "s://h.com/de/#x", "s://h.com/de", "s://K\u212a.net/p//q/", "s://com/fr/a", "s://org#/x", "a://b://c/d",
]


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, None))
    return host, path, rule, verdict


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u, "?") for k, u in enumerate(URLS)] + [(None, URLS[5], "?"), (5, URLS[5], "?")], "page_id long, url string, verdict string")
    out = judge_urls(df, rules=URL_RULES).collect()
    assert len(out) == len(URLS) + 2
    for r in out:
        host, path, rule, verdict = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule), r.url
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert judge_urls(df.limit(0), rules=URL_RULES).count() == 0


def test_rules_on_pages(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    for r in queries()["op9_urls"](spark, sf_dir).collect():
        host, path, rule, verdict = brute_url(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)


def brute_templates(rows, least_known=4, alike_z=1.64):
    """rows: (host, path, bad or None). The template of each, one node after the other."""
    out = [None] * len(rows)

    def split(host, at, level, members):
        labels = [rows[m][2] for m in members if rows[m][2] is not None]
        segments = {m: [x for x in rows[m][1].split("/") if x] for m in members}
        names = {m: None if len(x) <= level else "*" if re.search(r"[0-9]|^.{41,}$", x[level]) else x[level] for m, x in segments.items()}
        below = {n for n in names.values() if n}
        if len(labels) < 2 * least_known or len(set(labels)) < 2 or not below:
            for m in members:
                out[m] = at + "/**" if names[m] else at or "/"
            return
        kids = {}
        for n in below:
            own = [rows[m][2] for m in members if names[m] == n and rows[m][2] is not None]
            kept = False
            if n != "*" and len(own) >= least_known:
                k, b, rk, rb, p = len(own), sum(own), len(labels) - len(own), sum(labels) - sum(own), sum(labels) / len(labels)
                kept = len(below) == 1 or (rk > 0 and abs(b / k - rb / rk) / (p * (1 - p) * (1 / k + 1 / rk)) ** 0.5 > alike_z)
            kids.setdefault(n if kept else "*", []).extend(m for m in members if names[m] == n)
        for m in members:
            if names[m] is None:
                out[m] = at or "/"
        for n, own in kids.items():
            split(host, f"{at}/{n}", level + 1, own)

    for host in {r[0] for r in rows}:
        split(host, "", 0, [m for m, r in enumerate(rows) if r[0] == host])
    return out


def brute_verdicts(rows, reject_at=0.65, weight=2.0):
    templates = brute_templates(rows)
    labels = lambda keep: [r[2] for r, t in zip(rows, templates, strict=True) if r[2] is not None and keep(r, t)]
    everything = labels(lambda r, t: True)
    overall = (sum(everything) + 0.5) / (len(everything) + 1)
    out = []
    for r, t in zip(rows, templates, strict=True):
        host, own = labels(lambda x, _: x[0] == r[0]), labels(lambda x, u: (x[0], u) == (r[0], t))
        share = (sum(host) + weight * overall) / (len(host) + weight)
        purity = (sum(own) + weight * share) / (len(own) + weight)
        out.append((t, purity, "block" if purity >= reject_at else "allow"))
    return out


@pytest.mark.parametrize("seed, most", [(1, 50_000), (2, 0)])
def test_tree_is_the_brute_force_tree(spark, monkeypatch, seed, most):
    """Also where what the counts decide is looked up by the salted join."""
    monkeypatch.setattr(common, "MOST_BROADCAST", most)
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(600):
        host, path = f"h{rng.integers(4)}.net", [str(rng.choice(["a", "b", "c", "d9", "e"])) for _ in range(rng.integers(0, 5))]
        bad = 0.9 if "b" in path[:2] else 0.4 if host == "h2.net" else 0.1
        rows.append((host, "/" + "/".join(path), None if rng.random() < 0.3 else int(rng.random() < bad)))
    df = spark.createDataFrame([(k, f"http://{h}{p}?q=1", b) for k, (h, p, b) in enumerate(rows)], "k int, url string, label int")
    out = sorted(judge_urls(df, bad_col="label").collect(), key=lambda r: r.k)
    want = brute_verdicts(rows)
    assert len({t for t, _, _ in want}) > 5
    for r, (template, purity, verdict) in zip(out, want, strict=True):
        assert (r.template, r.verdict) == (template, verdict) and r.purity == pytest.approx(purity)


def test_templates_reject_by_labels(spark):
    rows = [(f"s://h.net/good/{k}", 0) for k in range(40)] + [(f"s://h.net/bad/{k}", 1) for k in range(40)] + [("s://h.net/bad/new", None), ("s://h.net/good/x7", None)]
    rows += [(f"s://none.net/{chr(97 + k)}/page", None) for k in range(20)] + [("s://two.net/x", 1), ("s://two.net/y", 1)]
    out = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "url string, label int"), bad_col="label").collect()}
    assert out["s://h.net/bad/new"].verdict == "block" and out["s://h.net/good/x7"].verdict == "allow"
    assert out["s://h.net/bad/3"].template == "/bad/**" and out["s://h.net/good/x7"].template == "/good/**"
    assert {(out[u].template, out[u].verdict) for u, _ in rows if "none" in u} == {("/**", "allow")}
    assert out["s://two.net/x"].verdict == "block"


def test_branches_differ_at_any_depth(spark):
    """Sections that differ only below eight others."""
    deep = "/".join("abcdefgh")
    rows = [(f"s://d.net/{deep}/{'bad' if k % 2 else 'good'}/{k}", k % 2) for k in range(40)]
    out = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "url string, label int"), bad_col="label").collect()}
    assert out[rows[1][0]].template == f"/{deep}/bad/**" and all(out[u].verdict == ("block" if bad else "allow") for u, bad in rows)


def test_ordinary_hosts_stay_and_labels_left_out_are_foretold(spark, sf_dir):
    """Without a rule no url is blocked whose host has no bad word; purities learned on half of the labels, none of a ruled url, tell the other half."""
    folder = sf_dir.replace("sf0.01", "sf0.1")
    out = queries()["op9_urls"](spark, folder).where("rule IS NULL").collect()
    words = lambda r: any(w in BAD_WORDS for w in re.split("[^a-z]+", f"{r.host}/{r.path}".lower()))
    assert {(words(r), r.verdict) for r in out} == {(False, "allow"), (True, "block")}
    urls = with_host_and_path(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url"))
    label = word_labels(urls, URL_RULES)
    urls = urls.select("page_id", "url", "host", "path", label.alias("full"), F.when(F.crc32("url") % 2 == 0, label).alias("half"))
    assert urls.where("full IS NOT NULL AND host LIKE '%.com' AND path LIKE '/de/%'").count() == 0
    left = judge_urls(urls.drop("host", "path"), bad_col="half").where("full IS NOT NULL AND half IS NULL").toPandas()
    right, plain = ((left.purity >= 0.5) == (left.full == 1)).mean(), 1 - left.full.mean()
    assert right > plain + 0.8 * (1 - plain)


def test_words_of_a_path_part_a_host(spark):
    """Sections of one host get both verdicts, by a word in the path, and so do urls of theirs that have no label of their own."""
    rows = [f"s://h.net/{'casino' if k % 2 else 'news'}/{'abcdefgh'[k % 8]}" for k in range(80)]
    out = {r.url: (r.template, r.verdict) for r in judge_urls(spark.createDataFrame([(u,) for u in [*rows, "s://h.net/casino/new?x", "s://h.net/news/new"]], "url string")).collect()}
    assert out["s://h.net/casino/new?x"] == ("/casino/**", "block") and out["s://h.net/news/new"] == ("/news/**", "allow")
    assert {v for _, v in out.values()} == {"allow", "block"}


def test_parts_and_articles_all_stay():
    """Short lists part the clusters of one content element; articles stand side by side."""
    items = [f"item {k}" for k in range(8)]
    part = "<h2>Head</h2>" + f"<p>{P}</p>" * 2 + "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>"
    text = "\n".join(["Head", P, P, *items])
    page = '<body><nav>Home</nav><div class="content">' + f'<div class="part">{part}</div>' * 3 + "</div><footer>foot</footer></body>"
    assert main_text(page) == "\n".join([text] * 3)
    page = f"<body><nav>Home</nav><article>{part}</article><article><h2>Two</h2><p>{P}</p></article><footer>foot</footer></body>"
    assert main_text(page) == f"{text}\nTwo\n{P}"


def test_wide_nodes_keep_what_differs(spark):
    """A branch with labels of its own stays one however many sections its host has."""
    rows = [(f"s://w.net/{chr(97 + k % 26)}{chr(97 + k // 26)}/{n}", 0) for k in range(80) for n in range(5)] + [(f"s://w.net/bad/{n}", 1) for n in range(40)]
    out = {r.url: r for r in judge_urls(spark.createDataFrame(rows, "url string, label int"), bad_col="label").collect()}
    assert out["s://w.net/bad/7"].template == "/bad/**" and all(out[u].verdict == ("block" if bad else "allow") for u, bad in rows)


#: Pages without a semantic element or a telling class: (page, text).
PLAIN = [
    ("<div id=top>Home | About | Login</div><div id=c><p>{P}</p><p>{P}</p></div><div>Footer text 2020</div>", "{P}\n{P}"),
    ("<body><div><a>Home</a></div><div><a>News</a></div><div><h1>Head</h1><p>{P}</p><p>Hm.</p><p>{P} {P}</p></div><div>Terms</div><div>Help</div></body>", "Head\n{P}\nHm.\n{P} {P}"),
    ("<div><div>Menu one</div><div>Menu two</div><p>{P}</p><p>{P}</p><ul><li>a</li><li>b</li></ul><p>{P}</p><div>Foot</div></div>", "{P}\n{P}\na\nb\n{P}"),
    ("<table><tr><td>Home</td><td><p>{P}</p><p>{P}</p><p>{P}</p></td><td>Links</td></tr></table>", "{P}\n{P}\n{P}"),
]
#: Class words and elements that content may have too.
CONTENT = [
    '<article><header><h1>Head</h1></header><p>{P}</p><div class="share-price"><p>{P}</p></div></article>', '<article><p>{P}</p><div class="response"><p>{P}</p></div></article>',
    "<article><p>{P} <math><mi>x</mi></math></p></article>", '<article><p>{P}</p><div class="related-work"><p>{P}</p></div></article>',
]


@pytest.mark.parametrize("page, text", PLAIN)
def test_ratios_choose_where_no_element_tells(monkeypatch, page, text):
    page, text = page.replace("{P}", P), text.replace("{P}", P)
    assert main_text(page) == text
    monkeypatch.setattr(html_text, "smoothed_ratios", lambda lines, sigma: np.ones(len(lines)))
    assert main_text(page) != text


@pytest.mark.parametrize("page", CONTENT)
def test_content_with_telling_words_stays(page):
    text = main_text(page.replace("{P}", P))
    assert text.count(P) == page.count("{P}") and ("Head" in text) == ("Head" in page) and ("x" in text) >= ("math" in page)


@pytest.mark.parametrize("page", ["<div>a b c" * 50_000, "<div><i>" * 40_000 + "</b></section>" * 40_000, "<p><b>x" * 60_000, "<div>" + "<i>" * 60_000 + "<p>x</p>" * 60_000])
def test_time_is_linear_in_open_elements(page):
    main_text(page[: len(page) // 8])
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10


def test_threshold_parts_two_clusters():
    for values in ([1.0, 1.0], [3.0], [1.0, 2.0, 9.0, 10.0], list(np.random.default_rng(4).gamma(2, 3, 60))):
        v, steps = np.array(values), sorted(set(values))
        cuts = [(a + b) / 2 for a, b in zip(steps, steps[1:], strict=False)]
        spread = lambda x: (v < x).sum() * (v >= x).sum() * (v[v < x].mean() - v[v >= x].mean()) ** 2
        assert html_text.threshold(v) == pytest.approx(max(cuts, key=spread) if cuts else v[0])
