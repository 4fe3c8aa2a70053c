"""Mixing, toxicity, search and page extraction on small tables."""

import math
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest

from gamelog.llm import oracle, queries, site_style_tree, source_mixing, toxicity, va_file

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import difference  # noqa: E402

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"create view {table} as select * from '{TINY}/{table}.parquet'")
    assert difference(queries.registered()[name](spark, TINY), con, oracle.oracle_sql()[name]) is None


def test_mixing_of_odd_rows(spark, folder, docs, no_docs, rows):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert difference(queries.registered()["op3_source_mixing"](spark, folder), con, oracle.MIXING) is None
    assert source_mixing.mix_sources(no_docs).count() == 0
    none = source_mixing.mix_sources(docs, weights={"src0": 0.0})
    assert none.count() == 0


def test_mixing_meets_its_weights(spark):
    docs = spark.range(20000).selectExpr(
        "id as doc_id", "repeat('x', 100) as text", "'en' as lang",
        "case when id % 10 < 7 then 'big' when id % 10 < 9 then 'mid' end as source", "100l as n_chars",
    )
    mixed = source_mixing.mix_sources(docs, weights={"big": 0.2, "mid": 0.5, None: 0.3}, epochs=2.0)
    shares = {r.source: r["count"] / 40000 for r in mixed.groupBy("source").count().collect()}
    assert shares == {k: pytest.approx(v, abs=0.01) for k, v in {"big": 0.2, "mid": 0.5, None: 0.3}.items()}
    assert mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0] > 3
    again = source_mixing.mix_sources(docs.repartition(7), weights={"big": 0.2, "mid": 0.5, None: 0.3}, epochs=2.0)
    assert mixed.limit(50).collect() == again.limit(50).collect()
    many = source_mixing.mix_sources(docs.limit(20), epochs=2000.0)
    assert many.count() == pytest.approx(20 * 2000, rel=0.05)


def test_toxicity_is_learned_from_other_rows(spark):
    rng = random.Random(3)
    plain = ["the", "house", "river", "walked", "slowly", "and", "green", "paper"]
    rows = []
    for i in range(1200):
        words = rng.choices(plain, k=rng.randint(3, 60))
        toxic = i % 4 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["gruk", "Blarg", "snivo"]))
        rows.append((i, " ".join(words), int(toxic)))
    odd = [(5000, None, None), (5001, "", None), (None, "gruk", None), (5002, "gruk " * 30000, None), (7, rows[7][1], 0)]
    labelled = spark.createDataFrame(rows + odd, "doc_id long, text string, toxic int")
    docs = labelled.selectExpr("doc_id", "text", "'x' as label", "'y' as score", "'z' as toxicity")
    labels = labelled.select("doc_id", "toxic").filter("toxic is not null")
    model = toxicity.learn(docs, labels)
    got = [(r.doc_id, r.text, r.toxicity) for r in toxicity.score_documents(docs, model).collect()]
    assert len(got) == len(rows) + len(odd) and all(0 <= s <= 1 for *_, s in got)
    truth = {i: t for i, _, t in rows}
    held = [(s, truth[i]) for i, _, s in got if i in truth and zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([(s >= 0.3) == bool(t) for s, t in held]) > 0.98
    score = {i: s for i, _, s in got}
    assert score[5002] > 0.5 and score[5000] == score[5001] < 0.5
    # labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    assert np.array_equal(toxicity.learn(docs, flipped).weights, model.weights)


def test_toxicity_without_labels(spark, no_docs, docs):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(no_docs, labels)
    assert toxicity.score_documents(no_docs, model).count() == 0
    assert {r.toxicity < 0.01 for r in toxicity.score_documents(docs, model).collect()} == {True}


def brute_grams(text, bits, orders):
    """Bucket numbers of a text's n-grams, by whole numbers."""
    top, out = 2**64, set()

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % top
        return x ^ (x >> 31)

    codes = [mixed(ord(c) + 1) for c in f"\n{text.lower()}\n"] if text else []
    for n in orders:
        for i in range(len(codes) - n + 1):
            h = 0
            for c in codes[i : i + n]:
                h = (h * 0xD6E8FEB86659FD93 + c) % top
            out.add(mixed((h + n) % top) >> (64 - bits))
    return out


def test_toxicity_query_matches_brute_force(spark, tmp_path):
    """Counts, ratios, regression and scores of the registered query, all worked out plainly."""
    rng = random.Random(8)
    plain = ["the", "house", "river", "walked", "slowly", "and", "green", "paper"]
    docs = [(i, " ".join(rng.choices(plain + ["gruk", "Blarg"] * (i % 3 == 0), k=rng.randint(2, 25)))) for i in range(90)]
    docs += [(90, None), (91, ""), (None, "gruk gruk"), (92, "Ünicode gruk 😀"), docs[5]]
    labels = [(i, int(i % 3 == 0)) for i in range(0, 88)] + [(90, 0), (92, 1), (None, 1), (3, None), (4, 0), (4, 1), (93, 1)]
    spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' as score", "'en' as lang").write.parquet(f"{tmp_path}/documents.parquet")
    frame = spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "1 as quality", "'clash' as text", "2 as label")
    frame.write.parquet(f"{tmp_path}/labels.parquet")
    bits, orders = toxicity.BUCKET_BITS, toxicity.ORDERS
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    known = {}
    for i, label in labels:
        if i is not None and label is not None and not held(i):
            known[i] = max(label, known.get(i, 0))
    rows = [(brute_grams(t, bits, orders), known[i]) for i, t in docs if i in known]
    texts = [sum(1 for _, y in rows if y == label) for label in (0, 1)]
    seen = [{}, {}]
    for grams, label in rows:
        for g in grams:
            seen[label][g] = seen[label].get(g, 0) + 1
    ratios = {}
    for g in seen[0].keys() | seen[1].keys():
        zero, one = seen[0].get(g, 0) + 1, seen[1].get(g, 0) + 1
        ratio = math.log(one / (texts[1] + 2)) - math.log(zero / (texts[0] + 2))
        if abs(ratio) / math.sqrt(1 / one + 1 / zero) >= toxicity.LEAST_Z:
            ratios[g] = ratio
    names = sorted(ratios)
    x = np.array([[ratios[g] if g in grams else 0.0 for g in names] for grams, _ in rows])
    y = np.array([label for _, label in rows], float)
    w, b = np.zeros(len(names)), math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    before, rate = (w, b), 4 / ((x**2).sum(1).max() + 1)
    for t in range(toxicity.STEPS):
        momentum = t / (t + 3)
        look_w, look_b = w + momentum * (w - before[0]), b + momentum * (b - before[1])
        miss = 1 / (1 + np.exp(-(x @ look_w + look_b))) - y
        before = (w, b)
        w, b = look_w - rate * (x.T @ miss / len(y) + toxicity.PENALTY * look_w), look_b - rate * miss.mean()
    weights = {g: v * ratios[g] for g, v in zip(names, w)}
    score = lambda t: 1 / (1 + math.exp(-b - sum(weights.get(g, 0.0) for g in brute_grams(t, bits, orders))))
    got = queries.registered()["op4_toxicity"](spark, str(tmp_path)).collect()
    want = sorted((-1 if i is None else i, held(i), score(t)) for i, t in docs)
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.score) for r in got)
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=2e-4)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def brute_top(vectors, k, every):
    scaled = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            scaled.setdefault(i, set()).add(tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
    out = set()
    for q, own in scaled.items():
        if q % every == 0:
            for v in own:
                hits = [(-sum(a * b for a, b in zip(v, w)), i) for i, ws in scaled.items() if i != q for w in ws if len(w) == len(v)]
                out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(hits)[:k], 1)}
    return out


def test_search(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 8)]) for i in range(700)]
    vectors += [(int(i), vectors[3][1]) for i in range(800, 860)]  # ties
    vectors += [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8), (950, [float("inf")] * 8), (None, [0.1] * 8)]
    vectors += [(1000, [0.5, 0.25]), (1001, [0.5, -0.25]), (1050, [3.0]), vectors[50], (1100, [1e6] * 8), (1101, [-1e6] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "'x' as score")
    got = {tuple(r) for r in va_file.exact_top_k(df.repartition(3), 5, 50).collect()}
    assert got == brute_top(vectors, 5, 50)
    assert va_file.exact_top_k(df.limit(0), 5, 50).count() == 0


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """One bar over all blocks; a second reading only of what reaches the kth exact score."""
    monkeypatch.setattr(va_file, "BLOCK_ROWS", 300)
    monkeypatch.setattr(va_file, "QUERY_ROWS", 16)
    read, scores = [], va_file.exact_scores

    def counted(pairs, whole):
        read.append(pairs.count())
        return scores(pairs, whole)

    monkeypatch.setattr(va_file, "exact_scores", counted)
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(0, 0.125, (3000, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert {tuple(r) for r in va_file.exact_top_k(df, 5, 50).collect()} == brute_top(rows, 5, 50)
    assert read[0] <= 60 * 20 and sum(read) < 60 * 3000 / 20


def test_no_side_of_a_search_is_broadcast(spark, monkeypatch):
    """Blocks of queries for every share, vectors and pairs pass the driver in no join, however few they seem."""
    plans, stored = [], va_file.stored
    monkeypatch.setattr(va_file, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df))
    df = spark.createDataFrame([(i, [i / 400, 0.5]) for i in range(300)], "vec_id long, embedding array<float>")
    found = va_file.exact_top_k(df, 5, 50)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in plan for plan in plans) >= 4 and not any("Broadcast" in plan for plan in plans)


def test_bounds_hold_in_any_cell():
    rng = np.random.default_rng(2)
    for scale in (50, 5000, 10**9):
        rows = rng.integers(-scale, scale, (200, 64))
        shift = max(1, int(scale).bit_length() - 7)
        lower, upper = va_file.score_bounds(rows[:9], (rows >> shift).astype(np.int8), shift)
        exact = rows[:9].astype(object) @ rows.T.astype(object)
        assert (lower <= exact).all() and (exact <= upper).all()


def test_scores_that_do_not_fit_fail(spark):
    df = spark.createDataFrame([(0, [1e15] * 4), (1, [1e15] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        va_file.exact_top_k(df, 5, 50).collect()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy &amp; save</div><div class="cookie-notice">We use cookies</div>
<article><header><h1>A &amp; B</h1></header><p><b>First  line.<br><p>Second&nbsp;one <span>in\nline</span> 1 < 2<aside>See also</aside>
<ul><li>x<li>y</ul><form><p>Mail</p><input></form><!-- <p>no</p> --><table><tr><td>c1<td>c2</table><div class="comments"><p>nice!</p></div></article>
<aside><p>Side</p></aside><footer>&copy; me</footer>"""


def test_article_text():
    text = site_style_tree.main_text(site_style_tree.parse(PAGE), {}, 0.2)
    assert text.split("\n") == ["A & B", "First line.", "Second one in line 1 < 2", "x", "y", "c1", "c2"]


@pytest.mark.parametrize("page, want", [
    ('<body class="single no-sidebar search"><div class=widget><article class="post has-sidebar comments"><p>one<p>two</article></div>', ["one", "two"]),
    ('<body class="has-header"><div class=text><p>one</div><div class="nav menu">x</div><div class=cookie-notice>y</div>', ["one"]),
    ('<article><h2 id="related-work">a</h2><h3 id=search class=header>b</h3><section id="search-methods">c</section><section id=notices>d</section>'
     '<div class="section" id="search">e</div><div class="social-impact">f</div><div id="comments">g</div><p class="related">h</p></article>',
     ["a", "b", "c", "d", "e", "f"]),
    ('<article>one two<div class=comments><article>x y z, x y z</article></div></article><div class=related><article>x</article></div>', ["one two"]),
    ('<div class=widget><article>one two</article></div><article>x</article>', ["one two", "x"]),
    ("<div class=sidebar><main>one</main></div><div class=sidebar>x</div>", ["one"]),
    ("<article></article><div>one</div>", ["one"]),
    ("<body><aside><article>x</article></aside><div class=sidebar><aside><article>y</article></aside></div><p>one", ["one"]),
    ("<body><form><p>one</p></form><nav>two</nav>", ["one", "two"]),
])
def test_labels_cut_no_text(page, want):
    assert site_style_tree.main_text(site_style_tree.parse(page), {}, 0.2).split("\n") == want


@pytest.mark.parametrize("inner", [
    '<div class="comment-list">x</div>', '<div class="reader-comments">x</div>', '<section class="post-comments">x</section>',
    '<div id="comments-area">x</div>', '<section id="comments">x</section>', '<ol id="comments"><li>x</ol>', '<div class="ad-slot">x</div>',
    '<div class="ad-container">x</div>', '<div class="cookie-bar">x</div>', '<div class="share-buttons">x</div>',
    '<div class="site-sidebar">x</div>', '<article class="comment"><p>x</article>', '<div itemprop="comment">x</div>',
])
def test_named_furniture_in_an_article_goes(inner):
    page = f'<body><div class="main-nav">x</div><article><p>one</p>{inner}<p>two</p></article><div class="site-footer">x</div>'
    assert site_style_tree.main_text(site_style_tree.parse(page), {}, 0.2) == "one\ntwo"


@pytest.mark.parametrize("page, want", [
    ("<article>energy is <math>E</math> here</article>", "energy is <E> here"),
    ("<article>press <button>Go</button> or <select><option>a</select></article>", "press Go or a"),
    ('<article class="comment post"><p>its own page</article>', "its own page"),
    ('<article><div class="post-content main-content">a</div><div class="right-post">b</div></article>', "a\nb"),
    ("<p>a < b <3 <", "a < b <3 <"),
    ('<p title="1 > 0">a</p><p title=\'"\'>b', "a\nb"),
    ('<p title="open>a</p><p>b', "a\nb"),
    ("<p>a<svg>b<p>c<!-- d", "ab\nc"),
])
def test_markup(page, want):
    got = site_style_tree.main_text(site_style_tree.parse(page), {}, 0.2)
    assert got == want.replace("<E>", "E")


@pytest.mark.parametrize("part", ["<a ", "<svg>", "<a \">\" ", "<a '\"", "<!-", "<a \"x\"", "<p title='", "</", "<script>x</script"])
def test_broken_markup_is_read_in_linear_time(part):
    import time

    for end in ("", ">", "\">"):
        start = time.process_time()
        site_style_tree._TagEnds and list(_tags(part * 60_000 + end))
        assert time.process_time() - start < 3


def _tags(page):
    ends, at = site_style_tree._TagEnds(page), 0
    while (start := page.find("<", at)) >= 0:
        *found, at = ends.tag(start)
        yield found


def test_a_long_broken_page(spark):
    import time

    start = time.process_time()
    for part in ("<a ", "<svg>", "<svg><a '"):
        site_style_tree.parse(part * 100_000)
    assert time.process_time() - start < 6


def test_entropy_removes_repeated_branches_of_articles(spark):
    """No label names the strip and the box inside of the articles; copies of one article stay whole."""
    rng = random.Random(9)
    text = lambda k: "".join(f"<p>{' '.join(str(rng.random()) for _ in range(9))}</p>" for _ in range(k))
    pages = [f"<article><div class=strip><b>Daily</b></div><h1>Same title</h1>{text(3)}<div class=low><div>Read our paper</div></div></article>" for _ in range(12)]
    copied = f"<article><div class=strip><b>Daily</b></div>{text(3)}</article>"
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)] + [(100 + i, f"http://b.example/{i}", copied) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in site_style_tree.extract_main_text(df).collect()}
    for i in range(12):
        assert got[i].startswith("Same title\n") and got[i].count("\n") == 3 and "Daily" not in got[i] and "paper" not in got[i]
    for i in range(6):
        assert got[100 + i].startswith("Daily\n") and got[100 + i].count("\n") == 3


def brute_importance(pages):
    """(site, path) to importances, counted with plain dictionaries: {site: [parsed page]}."""
    from collections import Counter

    out = {}
    for site_name, roots in pages.items():
        styles, texts, held = {}, {}, Counter()
        for root in roots:
            for path, style, own in site_style_tree.page_nodes(root):
                held[path] += 1
                styles.setdefault(path, Counter())[style] += 1
                texts.setdefault(path, Counter()).update(set(own))
        for path, m in held.items():
            if m == 1:
                out[site_name, path] = (1.0, 1.0, 1)
                continue
            entropy = sum(-c / m * math.log(c / m) / math.log(m) for c in styles[path].values())
            n = sum(texts[path].values())
            content = sum(c * (1 - math.log(c) / math.log(m)) for c in texts[path].values()) / n if n else 1.0
            out[site_name, path] = (entropy, content, m)
    return out


def test_style_tree_matches_plain_counting(spark):
    rows = [(u, p) for u, p in [*site(9, "a.example"), *site(4, "b.example"), *site(1, "c.example")]]
    parsed = {}
    for url, page in rows:
        parsed.setdefault(url.split("/")[2], []).append(site_style_tree.parse(page))
    want = brute_importance(parsed)
    df = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    keyed = site_style_tree._keyed_pages(df)
    schema = "doc long, tag long, site long, nodes array<struct<node: long, style: long, texts: array<long>>>"
    trees = keyed.select("doc", "tag", "site", "html").mapInArrow(site_style_tree._parse_batches, schema)
    sites = {r.site: r.host for r in keyed.selectExpr("site", "split(url, '/')[2] as host").distinct().collect()}
    got = {(sites[r.site], r.node): (r.presentation, r.content, r.pages) for r in site_style_tree.node_importance(trees).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-6)


def site(n, host):
    """Pages without an article element: a fixed strip and a fixed note around changing text."""
    rng = random.Random(n)
    for i in range(n):
        body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(9))}</p>" for _ in range(rng.randint(1, 5)))
        yield f"http://{host}/{i}", f"<body><div class=strip><div>Daily</div><div>Paper</div></div><div class=text>{body}</div><div class=low>Same on all</div></body>"


def test_entropy_removes_what_all_pages_of_a_site_share(spark):
    pages = [(i, *p) for i, p in enumerate([*site(30, "a.example"), *site(1, "b.example")])]
    odd = [(100, None, None), (101, "http://a.example/x", ""), (None, "x", "<p>alone</p>"), (102, "http://c.example", "<p>cut <b"), pages[0]]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string").selectExpr("*", "'t' as text", "'h' as site")
    got = [(r.page_id, r.text) for r in site_style_tree.extract_main_text(df.repartition(3)).collect()]
    assert len(got) == len(pages) + len(odd)
    text = dict(got)
    for i in range(30):
        assert "Daily" not in text[i] and "Same on all" not in text[i] and text[i].count("\n") == pages[i][2].count("<p>") - 1
    assert "Daily" in text[30]  # one page says nothing about its site
    assert text[100] == text[101] == "" and text[None] == "alone" and text[102].startswith("cut")
    assert site_style_tree.extract_main_text(df.limit(0)).count() == 0


def cards(n, host, frame):
    """Pages whose own text stands beside the same three articles."""
    rng = random.Random(host)
    for i in range(n):
        body = "".join(f"<p>{' '.join(str(rng.random()) for _ in range(9))}</p>" for _ in range(2))
        yield f"http://{host}/{i}", frame.format(f"<div class=text>{body}</div>")


def test_articles_beside_the_text(spark):
    teasers = "".join(f"<article><h3>Card {k}</h3><p>Read on</p></article>" for k in range(3))
    copied = "<article><h1>Copied</h1>" + "<p>the same long text</p>" * 40 + "</article>"
    frames = {
        "main": f"<body><main>{{}}<div class=cards>{teasers}</div></main>",
        "below": f"<body><main>{{}}</main><div class=cards>{teasers}</div>",
        "div": f"<body>{{}}<div class=cards>{teasers}</div>",
        "copies": f"<body><main>{{}}{copied}</main>",
    }
    pages = [(f"{name}{n}", *p) for name, frame in frames.items() for n in (20, 1) for p in cards(n, f"{name}{n}.example", frame)]
    df = spark.createDataFrame([(i, *p[1:]) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in site_style_tree.extract_main_text(df.repartition(3)).collect()}
    for i, (name, _, page) in enumerate(pages):
        own = [b.split("</p>")[0] for b in page.split("<div class=text>")[1].split("</div>")[0].split("<p>")[1:]]
        assert got[i].split("\n")[:2] == own
        assert ("Card" in got[i]) == (name in ("main1", "below1", "div1"))  # one page says nothing about its site
        assert ("Copied" in got[i]) == name.startswith("copies")
