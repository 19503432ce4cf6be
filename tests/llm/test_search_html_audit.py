"""Lexical search, html text and the audit of sources against brute force, and on odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from transferlake.llm import common, divergence, html_text, lexical, queries

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n long, terms long, item long, rank long, term string, value long"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, -1, -1, -1, -1, "x", -1) for r in rows], CLASHING)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11


def ranked(docs, items):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t))
    held = [(i, words) for i, t in docs if (words := split(t))]
    n_docs, tokens = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, words in held for t in set(words))
    out = []
    for item, text in items:
        scored = []
        for doc, words in held:
            tf, m = Counter(words), 100 - 75 + (75 * len(words) * n_docs) // tokens
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in split(text) if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda x: x[:3])
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(scored[:10])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


ODD_DOCS = [(1, None), (2, ""), (3, " \n--"), (4, "Alpha beta, gamma"), (5, "alpha beta gamma"), (5, "alpha beta gamma"), (None, "ALPHA beta gamma"), (6, "ünï-code 42 42 İx"), (7, "alpha " * 40_000 + "omega"), (8, "delta 42")]


def test_ranking_on_odd_rows(spark):
    docs = docs_of(spark, [(i, t, "en", None) for i, t in ODD_DOCS])
    asked = [(1, "alpha ALPHA gamma"), (1, "omega 42"), (2, None), (3, "--"), (None, "ünï delta"), (4, "nowhere"), (5, "alpha " * 3_000)]
    items = spark.createDataFrame([(i, t, -1, -1) for i, t in asked], "item_id long, text string, doc_id long, score long")
    got = lexical.rank_documents(docs, items)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert rows_of(got) == ranked(ODD_DOCS, asked)
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("slab, batch", [(7, 400), (200, 1 << 20)])
def test_ranking_matches_brute_force_over_slabs_and_batches(spark, monkeypatch, slab, batch):
    rng = random.Random(slab)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4_000)]
    docs = [(rng.randrange(150), " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for _ in range(160)]
    docs += [(500 + i, docs[3][1]) for i in range(25)]  # ties
    asked = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for i in range(30)]
    monkeypatch.setattr(lexical, "SLAB_DOCS", slab)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 3)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = lexical.rank_documents(frame, spark.createDataFrame(asked, "item_id long, text string"), batch_bytes=batch)
    assert rows_of(got) == ranked(docs, asked)


def slab_of(rng, docs, terms, items):
    rows = [sorted(rng.sample(range(terms), rng.randrange(1, terms // 2))) for _ in range(docs)]
    flat = np.array([t for r in rows for t in r])
    values = np.array([int(1000 * rng.random() ** 4) * (1 + 20 * (t % 9 == 0)) for t in flat]) + 1
    asked = [sorted(Counter(rng.choices(range(terms), k=8)).items()) for _ in range(items)]
    made = lexical.Items(list(range(items)), asked, terms)
    return lexical.Slab(made, np.arange(docs) * 3, np.cumsum([0, *map(len, rows)]), flat, values), asked, rows


def test_blocks_are_skipped_and_bounds_hold():
    rng = random.Random(5)
    slab, asked, rows = slab_of(rng, 600, 40, 12)
    best, counted = lexical.Best(12), Counter()
    lexical.search_slab(slab, best, counted)
    value = {(r, t): int(v) for r, t, v in zip(slab.rows, slab.terms, slab.values, strict=True)}
    want = []
    for i, own in enumerate(asked):
        scores = sorted((-sum(k * value.get((r, t), 0) for t, k in own), 3 * r) for r in range(600))
        want += [(i, -s, d) for s, d in scores[:10]]
    assert list(zip(best.item.tolist(), best.score.tolist(), best.doc.tolist(), strict=True)) == want
    assert counted["skipped"] > 0 and counted["scored"] < 600 * 12
    lists = np.arange(len(slab.list_terms))
    block, _ = slab.blocks(lists)
    summary = slab.summaries(block, slab.list_rows, int(block.max()) + 1)
    for b, r in zip(block.tolist()[::7], slab.list_rows.tolist()[::7], strict=True):
        assert all(summary[b * 40 + t] >= value[r, t] for t in rows[r])


# 12


def texts(spark, pages, **bounds):
    frame = spark.createDataFrame([(i, u, h, "x", -1) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string, host string, templates long")
    return [r.text for r in html_text.extract_text(frame, **bounds).orderBy("page_id").collect()]


FIXTURES = [
    ("<article><h1>A &amp; B</h1><p>one\n two<p>three <b>four</article>", "A & B\n\none two\n\nthree four"),
    ("<nav>menu<article><p>open menu</p></article>", "open menu"),
    ("<body><header>site</header><article><header><h1>T</h1></header><p>x</p><footer>f</footer></article><aside>s</aside>", "T\n\nx"),
    ("<p>a &lt;b&gt; &amp;lt; &eacute;&#233;&nbsp;c</p>", "a <b> &lt; éé c"),
    ("<article><script>var a='</p><p>no';</script><style>p{}</style><p>y<!-- <p>no</p> --></p></article><!-- open <p>z", "y"),
    ("<div class='layout with-sidebar'><article><p>kept</p></article><div id=side-bar class=sidebar>no</div></div>", "kept"),
    ("<article><p>text</p><div class='ad'>buy</div><section id='comments'><p>me too</p></section><form><input>send</form></article>", "text"),
    ("<article><p>text</p></article><article class='comment'>no</article><div role='banner'>no</div>", "text"),
    ("<main><h2>H</h2><p>m</p></main><div>outside</div>", "H\n\nm"),
    ("<div>outside</div><div class='post-content'>in <span class='advert'>no</span>side</div>", "in side"),
    ("<div class='cookie-notice'>we use</div><div>plain<br>text<hr>more</div>", "plain text\n\nmore"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b\n\nc"),
    ("<ul><li>a<li>b</ul>c", "a\n\nb\n\nc"),
    ("<article><div>x</p></div></section>y</div>z</article>", "x\n\ny\n\nz"),
    ("<form action='/'><article><p>a form around</p></article></form>", "a form around"),
    ("<p title='a>b' data-x=\"<p>\">quoted</p>", "quoted"),
    ("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>", "yes"),
    ("a < b and <3 >", "a < b and <3 >"),
    ("<script>never closed <p>x", ""),
    ("<TITLE>no</TITLE><P>UPPER</P>", "UPPER"),
    (None, ""),
    ("", ""),
    ("<article></article><p>the article is empty</p>", "the article is empty"),
]


def test_html_fixtures(spark):
    pages = [(f"https://h{i}.example/", h) for i, (h, _) in enumerate(FIXTURES)]
    assert texts(spark, pages) == [t for _, t in FIXTURES]


def test_templates_are_deleted_by_host_and_passages_stay(spark):
    menu = "<div><a href=/>Home</a><a href=/x>About</a></div><div>All rights reserved</div>"
    own = [("https://a.example/%d" % i, f"<body>{menu}<div><p>own text {i}</p><p>said once more</p></div></body>") for i in range(4)]
    other = [("https://b.example/1", f"<body>{menu}<div><p>elsewhere</p></div></body>")]
    got = texts(spark, own + other, least_pages=4)
    assert got[:4] == [f"own text {i}" for i in range(4)]
    assert got[4] == "HomeAbout\n\nAll rights reserved\n\nelsewhere"
    few = texts(spark, own[:3], least_pages=4)
    assert few[0].endswith("own text 0\n\nsaid once more")
    # within articles passages and copies stay, boxes of links go
    links = "<div><a href=/1>Read this</a> <a href=/2>and that</a></div>"
    articles = [("https://c.example/%d" % i, f"<article><p>{'a passage that all share ' * 20}</p><ul><li>shared item</li></ul><p>own {i}</p>{links}</article>") for i in range(9)]
    got = texts(spark, articles)
    assert all("a passage that all share" in t and "shared item" in t and t.endswith(f"own {i}") for i, t in enumerate(got))
    copies = texts(spark, [("https://d.example/%d" % i, "<body><div><p>an exact copy</p></div></body>") for i in range(9)])
    assert copies == ["an exact copy"] * 9


def test_html_on_odd_rows_and_long_pages(spark):
    long = "<article>" + "<p>word word</p>" * 60_000 + "</article>"
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000
    got = texts(spark, [(None, "<p>a</p>"), ("no address", "<p>a</p>"), ("https://x.example", long), ("https://x.example", long), ("https://y.example", deep), ("https://z.example", "<p a='" * 3_000)])
    assert got[:2] == ["a", "a"]
    assert got[2] == got[3] == "\n\n".join(["word word"] * 60_000)
    assert got[4] == "deep"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(empty).count() == 0


# 13


def audited(rows):
    """{(lang, source, part, item, value, rank)} from counts of all groups and terms."""
    langs = defaultdict(lambda: defaultdict(Counter))
    df = defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        langs[lang or ""][source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = set()
    for lang, groups in langs.items():
        kept = [t for t, n in df[lang].items() if n >= 3]
        counts = {s: {t: c[t] for t in kept} for s, c in groups.items()}
        whole = {t: sum(c[t] for c in counts.values()) for t in kept}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(whole)
        for s in groups:
            pairs = sorted(((-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in groups if o != s))
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] > 0 and p[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:200])}
    return out


@pytest.mark.parametrize("block, fan_in", [(40, 3), (500_000, 2_048)])
def test_audit_matches_brute_force_with_spills_and_rounds(spark, block, fan_in):
    rng = random.Random(block)
    words = [f"w{chr(97 + k % 26)}{'é' * (k % 3)}{chr(97 + k // 26)}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "b", "b", None, "ü", "x\ny"])) for i in range(400)]
    rows += [(None, None, "en", "only null"), (7, "", "fr", "s"), (7, "", "fr", "s"), (8, "Long word " * 30_000, "en", "a"), (9, "same same", "it", "q")] + [(10, "Ties here AND there", "pt", s) for s in "abcdd"]
    docs = docs_of(spark, rows).repartition(5)
    got = divergence.audit_sources(docs, block, fan_in)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    held = [tuple(r) for r in got.collect()]
    assert len(held) == len(set(held)) and set(held) == audited(rows)
    assert divergence.audit_sources(docs.limit(0)).count() == 0


def test_heap_merge_joins_runs_and_keeps_few_pieces_open():
    rng = random.Random(3)
    runs, want = [], defaultdict(lambda: [0, 0])
    for run in range(6):
        entries = sorted({(b"t%03d" % rng.randrange(200), k): rng.randrange(1, 9) for k in range(2) for _ in range(80)}.items())
        entries = [(t, k, n, 1) for (t, k), n in entries]
        for t, k, n, d in entries:
            want[t, f"s{k}"][0] += n
            want[t, f"s{k}"][1] += d
        runs += [((0, 0, "en"), entries[i][0], divergence.pack(["s0", "s1"], entries[i : i + 5])) for i in range(0, len(entries), 5)]
    merged = list(divergence.heap_merge(iter(sorted(runs, key=lambda r: r[1]))))
    assert [t for _, t, _ in merged] == sorted({t for t, _ in want})
    assert {(t, s): v for _, t, found in merged for s, v in found.items()} == dict(want)


def test_shares_are_exact_for_huge_counts(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000, 7)], "count long, n long, v long")
    got = df.select(divergence.scaled_share(*(df[c] for c in ("count", "n", "v")))).first()[0]
    assert got == 1 + 1_000_000_000 * (9_000_000_000_000_000_000 + 1) // (9_100_000_000_000_000_000 + 7)


def test_new_queries_read_whole_tables(spark):
    pages = common.table(spark, SF, "pages")
    assert queries.op12_html_text(spark, SF).count() == pages.count()
