"""The corpus operators against brute force, on small rows and on the small tables."""

import collections
import hashlib
import math
import os
import re
import sys
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import compare

from runledger.plans import lineage
from runledger.llm import catalog, components, decontaminate, exact_dedup, html_text, labelled, mixing, near_dedup, quality, sharding, tokens, toxicity, url_filter

FOLDER = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
SENTENCE = "the quick brown fox jumps over the lazy dog while seven small birds watch from a tall green tree near the old stone mill"
LONG = " ".join(f"w{i}" for i in range(30_000))

DOCS = [
    (1, "same text here", "en", "src0"),
    (2, "same text here", "en", "src0"),
    (2, "same text here", "en", "src0"),
    (3, None, None, None),
    (4, "", "de", "src1"),
    (5, " \t\n", "de", "src1"),
    (None, "no id at all in this row", "fr", None),
    (None, "no id at all in this row", "fr", None),
    (6, LONG, "en", "src2"),
    (7, LONG + " tail", "en", "src2"),
    (8, SENTENCE, "en", "src0"),
    (9, SENTENCE + " again", "en", "src0"),
    (10, "ﬁ ▁▁a\n b  <s>hi</s> <0x0A> 日本 é", "ja", "src3"),
    (11, "a b", "en", "src3"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: Names that the operators use inside.
CLASHING = ["k", "n", "t", "h", "row", "rid", "cls", "s", "u", "g", "size", "shard", "kept", "token", "place", "hot", "run", "lead", "words", "at"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({c: F.lit(1) for c in CLASHING})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def given(spark):
    return {t: spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "pages", "benchmark", "labels")}


def brute_groups(texts):
    words = [t.encode().lower().split() if t else [] for t in texts]
    sets = [({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set() for w in words]
    root = list(range(len(texts)))
    for _ in texts:  # as many rounds as a path can need
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
        if not changed:
            break
    return sets, root


@pytest.mark.parametrize("name", list(catalog.CORPUS_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    result = con.execute(catalog.CORPUS_SQL[name])
    columns = [d[0] for d in result.description]
    df = catalog.CORPUS_QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert compare.rows_of(df.columns, df.collect()) == compare.rows_of(columns, result.fetchall())


def test_every_operator_has_its_query():
    assert [q for n in range(1, 14) for q in catalog.CORPUS_QUERIES if q.startswith(f"op{n}_")] == [q for q in sorted(catalog.CORPUS_QUERIES, key=lambda q: int(q[2:].split("_")[0]) if q[:2] == "op" else 99) if q != "pipeline"]


# 1: url filters


def test_urls_hosts_and_rules(spark):
    rows = [(1, "https://WWW.Example.com/en/x?q=/es/"), (2, "http://a.example.com/en/"), (3, "x.net/es/"), (4, None), (5, "ftp://B.net/es/1#f"), (6, "http://net/fr/?a://b"), (7, "http://notnet/fr/"), (8, "http://example.com"), (9, "")]
    got = {r.page_id: tuple(r)[1:5] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), catalog.LISTED_RULES).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[3][:3] == ("", "", None) and got[4][:3] == ("", "", None) and got[9][:3] == ("", "", None)
    assert got[5] == ("b.net", "/es/1", "net/es/", "block")
    assert got[6] == ("net", "/fr/", "net/fr/", "block")
    assert got[7][:3] == ("notnet", "/fr/", None)
    assert got[8] == ("example.com", "", None, got[8][3])


def test_mined_rules_equal_counting_all_token_sets(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        items = sorted({f"path:{x}" for x in rng.choice(list("abcdef"), rng.integers(1, 5))})
        rows.append((items, "block" if ("path:a" in items and "path:b" in items) or rng.random() < 0.1 else "allow"))
    mined = {(tuple(sorted(r.tokens)), r.verdict): (r.hits, r.total) for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    sets = collections.Counter()
    for items, verdict in rows:
        for mask in range(1, 1 << len(items)):
            part = tuple(x for i, x in enumerate(items) if mask >> i & 1)
            sets[part] += 1
            sets[part, verdict] += 1
    least = math.ceil(0.05 * len(rows))
    rules = {k: (n, sets[k[0]]) for k, n in sets.items() if isinstance(k[0], tuple) and n >= least and n >= 0.8 * sets[k[0]]}
    kept = {}
    for (part, verdict), (hits, total) in rules.items():
        shorter = [rules.get((tuple(x for x in part if x != out), verdict)) for out in part]
        if not any(s and s[0] * total >= hits * s[1] for s in shorter):
            kept[part, verdict] = (hits, total)
    assert mined == kept and mined


def test_mined_verdicts_equal_brute_force(spark, given):
    judged = url_filter.judge_urls(given["pages"], catalog.LISTED_RULES).collect()
    base = given["pages"].select("page_id", "url").withColumn("host", url_filter.host_of(F.col("url"))).withColumn("path", url_filter.path_of(F.col("url")))
    base = base.withColumn("tokens", url_filter.url_tokens(F.col("host"), F.col("path"), F.col("url"))).withColumn("fit", url_filter.listed_rule(F.col("host"), F.col("path"), catalog.LISTED_RULES))
    rows = base.select("page_id", "tokens", "fit.verdict").collect()
    rules = url_filter.mine_rules(base.where("fit is not null").select("tokens", "fit.verdict")).collect()
    for r, (page, toks, listed) in zip(sorted(judged), sorted(rows)):
        best = max(((x.hits / x.total, x.hits, x.verdict, x.rule_id) for x in rules if set(x.tokens) <= set(toks)), default=None)
        assert r.page_id == page and r.verdict == (listed or (best[2] if best else "allow"))


def plain_rules(rows, support, confidence):
    """(tokens, verdict) -> (hits, total) of all rules that are not pruned, by counting every subset."""
    sets = collections.Counter()
    for items, verdict in rows:
        for mask in range(1, 1 << len(items)):
            part = frozenset(x for i, x in enumerate(items) if mask >> i & 1)
            sets[part] += 1
            sets[part, verdict] += 1
    least = math.ceil(support * len(rows))
    rules = {k: (n, sets[k[0]]) for k, n in sets.items() if isinstance(k, tuple) and n >= least and n >= confidence * sets[k[0]]}
    worse = lambda part, verdict, hits, total: (s := rules.get((part, verdict))) and s[0] * total >= hits * s[1]
    return {k: v for k, v in rules.items() if not any(worse(k[0] - {x}, k[1], *v) for x in k[0])}


def mined_of(spark, urls):
    df = spark.createDataFrame(urls, "url string, verdict string")
    tokens = url_filter.url_tokens(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url")), F.col("url"))
    return df.select(tokens.alias("tokens"), "verdict")


def test_rules_of_urls_whose_tokens_imply_each_other(spark):
    """Domains, their labels and tokens that always meet: the rules are those of all subsets."""
    rng = np.random.default_rng(4)
    hosts = ["a.b.net", "b.net", "net", "x.a.b.net", "q.org", "b.org", "a.b"]
    urls = []
    for _ in range(200):
        path = "".join(f"/{x}" for x in rng.choice(["en", "fr", "b"], rng.integers(0, 3)))
        bad = rng.random() < 0.5
        urls.append((f"http://{hosts[rng.integers(0, 4) if bad else rng.integers(0, 7)]}{path}{'?u=1&v=2' if rng.random() < 0.3 else ''}", "block" if bad or rng.random() < 0.2 else "allow"))
    labelled = mined_of(spark, urls)
    expected = plain_rules([(tuple(r.tokens), r.verdict) for r in labelled.collect()], 0.04, 0.7)
    got = {(frozenset(r.tokens), r.verdict): (r.hits, r.total) for r in url_filter.mine_rules(labelled, 0.04, 0.7).collect()}
    assert got == expected and any(len(k[0]) > 1 for k in got)


def test_a_host_of_twelve_labels_stays_small(spark, monkeypatch):
    """Without closing them its 24 tokens would be 2^24 item sets; strays make each level its own."""
    deep = [f"l{i}" for i in range(12)]
    urls = [(f"http://{'.'.join(deep)}/p{'/q' * (i % 2)}", "block") for i in range(400)]
    written = []
    monkeypatch.setattr(url_filter, "cut", lambda df: written.append(out := lineage.cut(df)) or out)
    alike = {(tuple(r.tokens), r.verdict) for r in url_filter.mine_rules(mined_of(spark, urls)).collect()}
    assert max(df.count() for df in written[2:]) < 100 and (("domain:" + ".".join(deep),), "block") in alike and len(alike) == 26
    written.clear()
    strays = [(f"http://{'.'.join(deep[i:])}/s", "allow") for i in range(12)]
    mined = url_filter.mine_rules(mined_of(spark, urls + strays))
    assert mined.where(F.array_contains("tokens", "domain:" + ".".join(deep))).count() == 1
    assert max(df.count() for df in written[2:]) < 1 << 17


def test_urls_empty_and_unlabelled(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string"), catalog.LISTED_RULES).collect() == []
    one = url_filter.judge_urls(spark.createDataFrame([(1, "http://x.org/a")], "page_id long, url string"), catalog.LISTED_RULES).collect()
    assert [tuple(r)[:5] for r in one] == [(1, "x.org", "/a", None, "allow")]


# 2: html


def test_html_blocks():
    page = '<article><header><h1>T &lt;b&gt;</h1></header><p>a<b>b</b> c\n d<ul><li>x<li>y</ul><aside>no</aside><section class="comments"><p>bad</p></section><form>q</form><p class=ad>buy<p>fine</article>'
    assert html_text.main_text(page) == "T <b>\nab c d\nx\ny\nfine"
    assert html_text.main_text(None) == "" == html_text.main_text("<nav>menu</nav><script>x='<p>a</p>'</script>")


def test_html_without_article_uses_the_surge():
    long_a, long_b = "long words here " * 10, "more text now " * 12
    page = f'<body><header>Site</header><div>home</div><div class="content"><p>{long_a}</p><p>short</p><p>{long_b}</p></div><div id="comments"><article>c1 text</article></div><footer>f</footer></body>'
    assert html_text.main_text(page).split("\n")[-3:] == [long_a.strip(), "short", long_b.strip()]


def test_html_names_of_wrappers_do_not_lose_the_text():
    story = "".join(f"<p>{x} real words of the story here, and more of them after that.</p>" for x in "abcd")
    want = [f"{x} real words of the story here, and more of them after that." for x in "abcd"]
    card = '<div class="related"><article>card</article></div>'
    pages = [
        f'<div class="content with-sidebar"><article>{story}</article></div>',
        f'<div id="page" class="no-comments"><article>{story}</article><div class="comments"><article>c1</article></div></div>',
        f'<div class="layout sidebar-left"><article>{story}</article><div class="sidebar"><a href=x>link</a></div></div>{card}',
        f'<div id="page" class="comments-open"><main><h1></h1>{story}</main></div>',
        f'<div class="menu-layout"><div>{story}</div><div class="share">tweet</div></div>',
        f'<div class="comments">{story}</div>',
        f'<article>{story}<div class="ad">{"buy now " * 100}</div></article>{card}',
        f'<div>{story}</div>{card}<div id="comments"><article>{"long comment " * 60}</article></div>',
    ]
    for page in pages:
        assert html_text.main_text(page).split("\n") == want, page
    assert html_text.main_text('<div class="ad">buy</div>') == ""


@pytest.mark.parametrize("element", ["<div>", ""])
def test_text_without_an_article_element(given, element):
    """The window sums find on their own what the element marks."""
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.1/pages.parquet'")
    want = {r[0]: r[2] for r in con.execute(catalog.CORPUS_SQL["op2_html_text"]).fetchall()}
    for page_id, page in con.execute("select page_id, html from pages").fetchall():
        assert html_text.main_text(page.replace("<article>", element).replace("</article>", element.replace("<", "</"))) == want[page_id], page_id


def test_window_sums_decide():
    line = lambda n, chrome=False: ("x" * n, 0, chrome, False)
    lines = [line(40, True), line(9), line(200), line(60, True), line(20), line(50, True), line(50, True), line(50, True), line(30), line(40, True)]
    lengths = lambda **k: [len(x) for x in html_text.text_lines(lines, **k)]
    assert lengths() == [9, 200, 20]  # over one chrome line, not over three; a short heading belongs to its text
    assert lengths(window=1) == [9, 200]
    assert lengths(window=4) == [9, 200, 20, 30]
    assert lengths(surge=1000, share=1.0) == []
    page = "<div>" + "word " * 60 + '</div><div class="ad">buy</div><div>last words</div><footer>f</footer>'
    assert html_text.main_text(page).endswith("last words")


@pytest.mark.parametrize("unit, closing", [("<p ", ""), ("<x a='", ""), ('<x "> "', ""), ("<font>", "</b>"), ("<div class='ad'>", "</p>"), ("</script ", ""), ("<a b=\"'>", ""), ("<!x", ""), ("<li><p>", "")])
def test_hostile_pages_take_linear_time(unit, closing):
    def seconds(n):
        page = unit * n + closing * n
        best = math.inf
        for _ in range(3):
            start = time.process_time()
            html_text.main_text(page)
            best = min(best, time.process_time() - start)
        return best

    n = 250_000 // len(unit + closing)
    assert seconds(2 * n) < 4 * seconds(n) + 0.2 and seconds(2 * n) < 5


def test_html_rows(spark, given):
    rows = spark.createDataFrame([(1, "u", None), (None, None, ""), (3, "u", "<p>" + "word " * 200_000), (3, "u", "a < b & c &amp; d")], "page_id long, url string, html string")
    got = {(r.page_id, r.n_chars): r.text for r in html_text.extract_main_text(rows).collect()}
    assert got[1, 0] == "" and got[None, 0] == "" and got[3, 999_999].startswith("word word") and got[3, 13] == "a < b & c & d"
    whole = html_text.extract_main_text(given["pages"]).toPandas()
    assert len(whole) == given["pages"].count() and (whole["text"].str.len() == whole["n_chars"]).all()
    assert html_text.extract_main_text(rows.limit(0)).collect() == []


# 3: exact dedup


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(docs, keep):
    got = exact_dedup.content_groups(docs, keep=keep).collect()
    assert len(got) == len(DOCS)
    for r in got:
        digests = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t, *_ in DOCS}
        mates = [i for i, t, *_ in DOCS if (t or "") == digests[r.text_sha256]]
        ids = [i for i in mates if i is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        assert (r.keep_id, r.group_size, r.kept) == (best, len(mates), r.doc_id == best)


def test_exact_groups_of_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(3000)]
    got = exact_dedup.content_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.keep_id for r in got if r.doc_id % 3} == {2999} and {r.group_size for r in got} == {1, 2000}
    assert sum(r.kept for r in got) == 1001


def test_repeated_rows_without_id_are_spread(spark, monkeypatch):
    """100,000 rows that nothing tells apart: no task and no run of the order holds more than a part of them."""
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    written = []
    monkeypatch.setattr(exact_dedup, "cut", lambda df: written.append(df) or lineage.cut(df))
    groups = exact_dedup.content_groups(rows).groupBy("keep_id", "group_size", "kept").count().collect()
    assert [tuple(r) for r in groups] == [(None, 100_000, True, 100_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert max(r["count"] for r in written[-1].groupBy(F.spark_partition_id()).count().collect()) < 70_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    cuts = []
    monkeypatch.setattr(sharding, "cut", lambda df: cuts.append(df) or lineage.cut(df))
    sharded = sharding.shard_documents(rows, 4, per_chunk=1_000)
    assert max(r["count"] for r in cuts[-1].groupBy("shard", "chunk", "own", "run").count().collect()) < 2_000
    assert sharded.agg(F.count_distinct("shard"), F.min("slot"), F.max("slot"), F.count_distinct("slot")).first()[:] == (1, 0, 99_999, 100_000)


def test_exact_groups_normalised_and_empty(docs, empty):
    assert exact_dedup.content_groups(empty).collect() == []
    upper = exact_dedup.content_groups(docs, normalise=lambda c: F.lit("x")).collect()
    assert {(r.keep_id, r.group_size) for r in upper} == {(11, len(DOCS))}


# 4: token counts


def test_token_counts(docs, empty):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=MODEL)
    for head in (1 << 17, 3, 0):
        got = sorted((repr(tuple(r)) for r in tokens.token_counts(docs, MODEL, 100, head=head).collect()))
        assert got == sorted(repr((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100)) for i, t, *_ in DOCS)
    assert tokens.token_counts(empty, MODEL).collect() == []


def test_token_counts_of_odd_texts(spark):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=MODEL)
    odd = [" ", "  ", "   a   b ", "▁", "a▁▁b", "\n\n", "\t x", "\u3000 a", "\x00a", "<unk>", "é é", "a" * 5000, " " * 300, "x" + " " * 17 + "y", "👍🏽 ok"]
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"), MODEL).collect()}
    assert got == {i: len(model.encode(t)) for i, t in enumerate(odd)}


# 5: mixing


def margins():
    return [mixing.Margin("source", F.col("source"), {"src0": 0.4, "src1": 0.2}), mixing.Margin("lang", F.col("lang"), {"en": 0.5, "de": 0.3})]


def test_raking_meets_margins():
    rng = np.random.default_rng(3)
    weights = rng.integers(50, 100, (3, 2, 4)).astype(float)
    targets = [np.array([0.3, 0.3, 0.4]), np.array([0.5, 0.5]), np.array([0.25] * 4)]
    found = mixing.rake(weights, targets, 0.4)
    assert found.error < 1e-9 and found.probabilities.max() <= 1
    for axis, t in enumerate(targets):
        share = (found.probabilities * weights).sum(axis=tuple(i for i in range(3) if i != axis)) / weights.sum()
        assert np.allclose(share, t * 0.4)


def test_raking_of_what_is_missing():
    found = mixing.rake(np.array([[10.0, 0], [90, 0]]), [np.array([0.5, 0.5]), np.array([0.5, 0.5])], 0.5)
    assert np.allclose((found.probabilities * [[10, 0], [90, 0]]).sum(axis=1), [10, 40])
    assert mixing.rake(np.zeros((2, 2)), [np.array([0.5, 0.5])] * 2, 0.5).error == 0


def test_drawn_documents(docs, empty):
    drawn = mixing.draw_documents(docs, margins(), 0.6)
    rows = drawn.collect()
    assert len(rows) == len(DOCS) and drawn.columns[: len(docs.columns)] == docs.columns
    weights = collections.Counter()
    for i, t, lang, source in DOCS:
        weights[source if source in ("src0", "src1") else mixing.REST, lang if lang in ("en", "de") else mixing.REST] += len((t or "").split())
    table = np.array([[weights[a, b] for b in ("en", "de", mixing.REST)] for a in ("src0", "src1", mixing.REST)], float)
    p = mixing.rake(table, [np.array([0.4, 0.2, 0.4]), np.array([0.5, 0.3, 0.2])], 0.6).probabilities
    for r in rows:
        at = (("src0", "src1", mixing.REST).index(r.mix_cell[0]), ("en", "de", mixing.REST).index(r.mix_cell[1]))
        assert math.isclose(r.mix_probability, p[at]) and r.mix_tokens == len((r.text or "").split())
    assert mixing.draw_documents(docs, margins(), 1.0).where("not mix_drawn and mix_probability >= 1").count() == 0
    assert mixing.mix_documents(empty, margins(), 0.5).collect() == []


def test_draws_follow_the_targets(spark):
    rows = [(i, "one two three four", "en" if i % 10 else "de", f"src{i % 3}") for i in range(6000)]
    drawn = mixing.draw_documents(spark.createDataFrame(rows, SCHEMA), [mixing.Margin("source", F.col("source"), {"src0": 0.5}), mixing.Margin("lang", F.col("lang"), {"de": 0.15})], 0.5).where("mix_drawn").toPandas()
    assert abs(len(drawn) - 3000) < 150 and abs((drawn.source == "src0").mean() - 0.5) < 0.03 and abs((drawn.lang == "de").mean() - 0.15) < 0.02


# 6: near duplicates


def noisy(rng, words, share):
    return [f"z{rng.integers(1 << 40)}" if rng.random() < share else w for w in words]


def family(size, length, share, seed):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}x{i}" for i in range(length)]
    return [" ".join(noisy(rng, base, share * rng.random())) for _ in range(size)]


def check_groups(spark, texts):
    got = {r.doc_id: r for r in near_dedup.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets, root = brute_groups(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root[i], root[i] == i), i


def test_near_groups_against_brute_force(spark):
    texts = family(60, 150, 0.1, 1) + family(40, 60, 0.06, 2) + family(20, 300, 0.3, 3)
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join([f"q{j}x{i}" for i in range(20 + 10 * j)] + passage) for j in range(25)]
    texts += ["", "one two", "ONE  two", "one two three four five", None, SENTENCE, SENTENCE.upper(), LONG, LONG + " end"]
    check_groups(spark, texts)


def test_near_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    check_groups(spark, family(80, 120, 0.12, 5) + family(30, 80, 0.2, 6))


def test_near_groups_of_given_rows(docs, empty):
    got = near_dedup.near_groups(docs).collect()
    assert len(got) == len(DOCS)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[2, 1].component_id == 1 and by[9, len(SENTENCE.split()) - 3].component_id == 8 and by[7, 29_997].component_id == 6
    assert by[3, 0].component_id == 3 and by[5, 0].kept and by[None, 3].component_id is None
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, None, 6, 8, 10, 11], key=repr)
    assert near_dedup.near_groups(empty).collect() == [] == near_dedup.keep_one_of_each(empty).collect()


def test_different_texts_of_one_id_are_kept_apart(spark):
    rows = [(1, SENTENCE), (2, "an entirely different text of nine words or so"), (2, SENTENCE + " again"), (2, "an entirely different text of nine words or so"), (2, "and a third one that nothing else is like"), (None, "no id")]
    for n in (1, 7):
        kept = near_dedup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(n)).collect()
        assert sorted(map(tuple, kept), key=repr) == sorted({rows[0], rows[1], rows[4], rows[5]}, key=repr)


def test_estimate_is_close_to_the_overlap():
    rng = np.random.default_rng(4)
    for j in (0.5, 0.75, 0.9):
        errors = []
        for _ in range(20):
            n = 400
            both = int(2 * n * j / (1 + j))
            pool = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            a, b = near_dedup.registers(pool[:n]), near_dedup.registers(pool[n - both :])
            size = np.array([float(n)])
            errors.append(near_dedup.estimate(np.array([(a == b).sum()]), np.array([(a > b).sum()]), size, size)[0] - j)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.06


def test_registers_merge_by_their_maximum():
    pool = np.random.default_rng(8).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert (near_dedup.registers(pool) == np.maximum(near_dedup.registers(pool[:1700]), near_dedup.registers(pool[1700:]))).all()


def test_components(spark):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(50)]
    root = {}
    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {k: got.get(k, k) for k in root} == {k: find(k) for k in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# 7 and 8: classifiers


def test_quality_learns_and_scores(spark, docs, empty):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(SENTENCE.split(), 60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "NOW!!", "###", "$$$"], 60)) for _ in range(60)]
    net = quality.train_network([(t, 1) for t in good[:40]] + [(t, 0) for t in bad[:40]], epochs=12)
    assert quality.score_quality_texts(net, good[40:]).min() > 0.7 and quality.score_quality_texts(net, bad[40:]).max() < 0.3
    scored = quality.judge_quality(quality.score_quality(docs, net), 0.3)
    rows = scored.collect()
    assert len(rows) == len(DOCS) and scored.columns == [*docs.columns, "quality_score", "predicted"]
    assert all(0 <= r.quality_score <= 1 and r.predicted == (r.quality_score >= 0.3) for r in rows)
    assert len({r.quality_score for r in rows if r.doc_id in (3, 4)}) == 1
    assert quality.score_quality(empty, net).collect() == []
    assert quality.train_network([("a", 1), ("b", 1)]) is None and quality.score_quality_texts(None, ["a"]).tolist() == [0.5]


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        chunks = quality.cut_chunks(text)
        hop = quality.CHUNK - quality.OVERLAP
        joined = np.concatenate([chunks[0], *[c[quality.OVERLAP :] for c in chunks[1:]]]) if len(chunks) else []
        assert bytes(joined[joined != quality.PAD].astype(np.uint8)).decode() == text and len(chunks) == max(1, -(-(n - quality.OVERLAP) // hop))


def test_held_out_quality_on_given_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = catalog.CORPUS_QUERIES["op7_quality"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95 and got.predicted[got.quality == 1].mean() > 0.97


def test_held_out_toxicity_on_given_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = catalog.CORPUS_QUERIES["op8_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").toPandas()
    assert got.predicted[got.toxic == 0].mean() < 0.01 and got.predicted[got.toxic == 1].mean() > 0.9


def brute_marginals(potentials, transitions, start):
    n, total, toxic = len(potentials), 0.0, np.zeros(len(potentials))
    for states in range(1 << n):
        y = [states >> i & 1 for i in range(n)]
        w = math.exp(start[y[0]] + sum(potentials[i] * y[i] for i in range(n)) + sum(transitions[y[i]][y[i + 1]] for i in range(n - 1)))
        total += w
        toxic += w * np.array(y)
    return toxic / total


def test_marginals_equal_summing_all_paths(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(toxicity, "ROW", 5)
    lengths = [1, 7, 3, 10, 1, 6]
    potentials, trans, start = rng.normal(0, 2, sum(lengths)), rng.normal(0, 1, (2, 2)), rng.normal(0, 1, 2)
    starts = np.zeros(sum(lengths), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    p = toxicity.marginals(potentials, starts, trans, start)[0]
    at = 0
    for n in lengths:
        assert np.allclose(p[at : at + n], brute_marginals(potentials[at : at + n], trans, start))
        at += n


def toxic_model():
    rng = np.random.default_rng(9)
    plain = [f"{a}{b}" for a in ("la", "mo", "ri", "sen", "tu") for b in ("ka", "ver", "lin", "dos")]
    text = lambda extra: " ".join(rng.permutation([*rng.choice(plain, 40), *extra]))
    sample = [(text([]), 0) for _ in range(80)] + [(text(rng.choice(["nastio", "nastia", "uglum"], 2)), 1) for _ in range(80)]
    return toxicity.train_field(sample), plain


def test_toxic_words_are_found_with_their_offsets(docs, empty):
    model, plain = toxic_model()
    text = f"{' '.join(plain[:5])} Nastio, {' '.join(plain[5:9])} nastissimo."
    (score, spans), (clean, none) = toxicity.score_texts(model, [text, " ".join(plain)])
    assert score > 0.7 > 0.3 > clean and none == [] and [text[s["start"] : s["end"]] for s in spans] == ["Nastio", "nastissimo"]
    scored = toxicity.score_toxicity(docs, model)
    rows = scored.collect()
    assert len(rows) == len(DOCS) and scored.columns == [*docs.columns, "toxic_score", "toxic_spans"]
    assert all(r.toxic_score == 0 and r.toxic_spans == [] for r in rows if r.doc_id in (3, 4, 5))
    assert toxicity.score_toxicity(empty, model).collect() == []
    assert {r.toxic_score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}
    assert toxicity.train_field([("a b c", 0)]) is None and toxicity.train_field([]) is None


def test_long_texts_in_pieces_score_alike(monkeypatch):
    model, plain = toxic_model()
    text = " ".join([*plain * 40, "nastio", *plain * 40])
    whole = list(toxicity.score_texts(model, [text, text]))
    monkeypatch.setattr(toxicity, "PIECE", 100)
    monkeypatch.setattr(toxicity, "OVERLAP", 30)
    pieces = list(toxicity.score_texts(model, [text, text]))
    assert np.allclose([s for s, _ in whole], [s for s, _ in pieces]) and [x["start"] for x in whole[0][1]] == [x["start"] for x in pieces[1][1]]


def test_sample_is_bounded_and_learns_from_its_fold(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(7, 1), (None, 1)], "doc_id long, toxic int")
    sample = labelled.labelled_sample(docs, labels, "toxic", labelled.fold(F.col("k"), 3) != 1, 20)
    assert collections.Counter(y for _, y in sample) == {0: 20, 1: 20}
    assert all(zlib.crc32(t.split()[1].encode()) % 3 != 1 and int(t.split()[1]) % 2 == y for t, y in sample)


# 9: decontamination


def test_leaks(spark, docs, empty):
    rng = np.random.default_rng(3)
    item = [f"i{k}" for k in range(30)]
    short = ["alpha", "beta", "gamma", "delta", "eps", "zeta"]
    fill = lambda n: [f"f{x}" for x in rng.integers(0, 1000, n)]
    swapped = list(item)
    for k in (6, 13, 20, 27):
        swapped[k] = "other"
    rows = [
        (1, " ".join(fill(50) + item + fill(50))),
        (2, " ".join(fill(500) + swapped + fill(5))),
        (3, " ".join(fill(20) + item[5:16])),
        (4, " ".join(fill(20) + item[5:11] + fill(20))),
        (5, "Alpha, beta; GAMMA delta eps zeta"),
        (6, "alpha beta gamma delta eps"),
        (7, None),
        (8, ""),
        (9, " ".join(fill(300))),
        (None, " ".join(item)),
        (1, " ".join(fill(50))),
        (10, " ".join(item + fill(100) + item)),
    ]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, None), (4, ""), (None, " ".join(item)), (5, "one two")], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in CLASHING})
    got = sorted((tuple(r) for r in decontaminate.flag_leaks(table, bench).collect()), key=repr)
    assert len(got) == len(rows)
    flagged = {(r[0], r[3], r[6]) for r in got if r[1]}
    assert flagged == {(1, 1, 30), (2, 1, 24), (3, 1, 11), (5, 2, 6), (None, 1, 30), (10, 1, 30)}
    kept = decontaminate.drop_leaks(table, bench)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8, 9]
    assert decontaminate.flag_leaks(table, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.flag_leaks(empty, bench).collect() == []


def test_leaks_of_given_rows_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {r.doc_id: r.contaminated for r in decontaminate.flag_leaks(docs, bench).collect()}
    words = lambda t: decontaminate.WORD.findall((t or "").lower())
    runs = collections.defaultdict(set)
    for r in bench.collect():
        w = words(r.text)
        for i in range(len(w) - 9):
            runs[tuple(w[i : i + 10])].add(r.item_id)
    for r in docs.collect():
        w = words(r.text)
        if any(tuple(w[i : i + 10]) in runs for i in range(len(w) - 9)):
            assert got[r.doc_id]
    assert 0 < sum(got.values()) < 0.1 * len(got)


def leak_at(words, item):
    """Whether any part of any alignment is a leak, by trying them all."""
    n = len(item)
    for shift in range(-n + 1, len(words)):
        same = [0 <= i + shift < len(words) and words[i + shift] == item[i] for i in range(n)]
        for i in range(n):
            for j in range(i + 1, n + 1):
                equal = sum(same[i:j])
                if (equal == n if n < 8 else (equal >= 10 or equal >= math.ceil(0.6 * n)) and equal >= 0.75 * (j - i)):
                    return True
    return False


def test_every_overlap_that_is_a_leak_has_a_seed():
    for n in range(8, 18):
        for inner in range(1, 1 << 16):
            pattern = f"{inner:b}1"
            equal = pattern.count("1")
            if len(pattern) <= n and (equal >= 10 or equal >= math.ceil(0.6 * n)) and equal >= 0.75 * len(pattern):
                assert any(re.search(f"(?={m.replace('0', '.')})", pattern) for m in decontaminate.masks_of(n)), (n, pattern)


def test_no_long_overlap_without_a_seed():
    """Over all ways to go on without a seed, by the last words alone: the best of 1 for an equal word and -3 for another falls for good."""
    masks = [int(m, 2) for m in decontaminate.masks_of(60)]
    width = max(m.bit_length() for m in masks)
    best = {1: 1}
    for length in range(2, 300):
        further: dict[int, int] = {}
        for last, score in best.items():
            for bit in (0, 1):
                now = (last << 1 | bit) & ((1 << width) - 1)
                if not (bit and any(now & m == m for m in masks)):
                    further[now] = max(further.get(now, -(10**9)), score + (1 if bit else -3))
        best = further
        assert not any(score >= 0 and (3 * length + score) // 4 >= 10 and last & 1 for last, score in best.items()), length
    assert max(best.values()) < -20


def test_masks_ignore_positions():
    assert all("0" in m for n in range(8, 60) for m in decontaminate.masks_of(n))
    assert all(m.count("1") >= 5 for n in range(11, 60) for m in decontaminate.masks_of(n))


def test_short_items_are_looked_for_if_asked(spark):
    bench = spark.createDataFrame([(1, "one two"), (2, "solo")], "item_id long, text string")
    table = spark.createDataFrame([(1, "a one two b"), (2, "one b two"), (3, "solo"), (4, "")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ["row", "ROW2", "__row", "_row"]})
    assert {r.doc_id for r in decontaminate.drop_leaks(table, bench, shortest_item=1).collect()} == {2, 4}
    kept = decontaminate.drop_leaks(table, bench)
    assert kept.columns == table.columns and kept.count() == 4


def test_leaks_of_a_very_long_text(spark):
    item = [f"i{k}" for k in range(40)]
    words = [f"w{k % 5000}" for k in range(600_000)]
    words[400_000:400_012] = item[10:22]
    table = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:300_000])), (2, None)], "doc_id long, text string")
    found = decontaminate.find_leaks(table, spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.start_word, r.n_words, r.equal_words) for r in found} == {(1, 1, 400_000, 12, 12), (1, 2, 400_000, 12, 12)}


def test_leaks_with_substitutions_against_brute_force(spark):
    rng = np.random.default_rng(12)
    items = [[f"i{k}x{x}" for x in range(n)] for k, n in enumerate([5, 7, 8, 8, 9, 10, 10, 12, 12, 13, 15, 15, 16, 20, 40])]
    texts = [items[7][:6] + ["other"] + items[7][7:], items[14][10:15] + ["other"] + items[14][16:21], items[3][:2] + ["a"] + items[3][3:5] + ["b"] + items[3][6:]]
    texts += [[x if k % 4 != 3 else "other" for k, x in enumerate(items[12])], items[14][:9] + ["a"] * 12 + [x if k % 4 != 3 else "b" for k, x in enumerate(items[14][21:37])]]
    for _ in range(400):
        item = items[rng.integers(len(items))]
        begin = int(rng.integers(0, max(1, len(item) - 9)))
        part = list(item[begin : begin + int(rng.integers(8, 17))])
        for place in rng.choice(len(part), min(len(part), int(rng.integers(0, 5))), replace=False):
            part[place] = "other"
        texts.append([f"f{x}" for x in rng.integers(0, 1000, 12)] + part + [f"f{x}" for x in rng.integers(0, 1000, 12)])
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    table = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, bench).collect()}
    mine = [{x.split("x")[0] for x in t if x[0] == "i"} for t in texts]
    want = {(d, k) for d, t in enumerate(texts) for k, item in enumerate(items) if f"i{k}" in mine[d] and leak_at(t, item)}
    assert got == want and {d for d, _ in want} >= {0, 1, 2, 3, 4} and len(want) < len(texts)


# What all share: names and samples


def test_given_columns_keep_their_values(spark, docs):
    given = {c: F.lit(f"given {c}") for c in ["toxic_score", "Toxic_Spans", "mix_cell", "mix_drawn", "margin0", "id", "key", "__id", "__key", "__mix0", "given_mix_cell"]}
    table = docs.withColumns(given)
    model = toxicity.learn_toxic_field(*(spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels")))
    for kept in (toxicity.drop_toxic(table, model, 0.7), near_dedup.keep_one_of_each(table), mixing.mix_documents(table, mixing.document_margins(), 1.0)):
        assert kept.columns == table.columns
        rows = kept.collect()
        assert rows and all(r[c] == f"given {c}" for r in rows for c in given)


def test_labelled_sample_is_bounded_in_rows(spark):
    one = spark.range(20_000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("copy "), (F.col("id") % 3).cast("string")).alias("text"))
    rows = one.unionAll(spark.createDataFrame([(8, "other"), (9, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 0), (7, 1), (8, 0), (9, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    samples = {tuple(labelled.labelled_sample(rows.repartition(5), labels, "toxic", F.lit(True), 10)) for _ in range(2)}
    (sample,) = samples  # the same each time
    assert len(sample) == 2 and ("other", 0) in sample and {y for t, y in sample if t != "other"} == {1}


def test_long_pre_tokens_are_neither_held_nor_shuffled(spark):
    """Texts without blanks are counted where they are."""
    rows = [(i, chr(0x4E00 + i % 50) * 500 + "文" * i) for i in range(100)] + [(1000, "short words " * 40)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    passed = table.select("text").mapInArrow(tokens._frequencies, "token string, n long")
    assert passed.agg(F.max(F.length("token"))).first()[0] <= tokens.LONGEST
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(table, MODEL).collect()}
    assert got == {i: len(processor.encode(t)) for i, t in rows}


# 10: sharding


def test_differencing_is_exact_on_its_sums():
    rng = np.random.default_rng(5)
    weights = rng.integers(1, 1000, 200).tolist()
    sums, places = sharding.difference([[w] + [0] * 7 for w in weights], 8)
    own = [0] * 8
    for w, place in zip(weights, places):
        assert sorted(place) == list(range(8))
        own[place[0]] += w
    assert own == sums and max(own) - min(own) <= 10
    assert sharding.difference([], 3) == ([0, 0, 0], [])


@pytest.mark.parametrize("per_part", [5000, 3])
def test_shards(docs, empty, per_part):
    rows = sharding.shard_documents(docs, 4, per_part=per_part, per_chunk=2).collect()
    assert len(rows) == len(DOCS) and sharding.shard_documents(empty, 4).collect() == []
    assert sorted((r.size, r.text_crc32) for r in rows) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in DOCS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(4))
    homes = collections.defaultdict(set)
    for r in rows:
        homes[r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in homes.values()) and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_shards_are_even_over_many_parts(spark):
    rng = np.random.default_rng(7)
    rows = [(i, "x" * int(n) + str(i)) for i, n in enumerate(rng.integers(1, 400, 2000))]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16, per_part=100).toPandas().groupby("shard")["size"].sum()
    assert got.max() - got.min() <= 0.002 * got.sum() / 16
