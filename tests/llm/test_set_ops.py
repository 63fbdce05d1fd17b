"""Near duplicates, components, archives, main text, top-k, images, pipeline: against brute force and on odd tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparrowdex.llm import components, html_text, language, media, near_dup, queries, topk, warc, workspace
from sparrowdex.llm.shingles import shingle_sets


def brute_set(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, per_cent):
    """{id: (set size, smallest id reachable)}; rows: (id, text)."""
    sets = [(d, brute_set(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= per_cent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets}


def edited(words, n, r):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


def corpus(seed=1):
    r = random.Random(seed)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for _ in range(40):
        base = [f"b{r.randrange(3000)}" for _ in range(r.randint(8, 200))]
        if r.random() < 0.5:
            base = passage + base
        rows.append(" ".join(base))
        rows += [" ".join(edited(base, r.randint(0, 6), r)) for _ in range(r.randint(0, 5))]
    rows += [None, "", " \n\t", "one two three", "One TWO three", "one two", "É é x y z", "é é x y z", "word " * 30000, "a b c d e"]
    r.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("per_cent", [80, 85])
def test_near_duplicates_are_all_there(spark, per_cent):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x", 1, "n") for i, t in rows] + [(None, "one two three", "y", 2, "m")], "doc_id long, text string, rep string, n int, node string")
    got = near_dup.near_duplicates(df, per_cent).collect()
    want = brute_components(rows, per_cent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got) and len(got) == len(rows) + 1


def test_a_large_group_of_near_copies(spark):
    """More copies than a leaf holds: nodes branch on, coherent ones are dealt."""
    r = random.Random(2)
    base = [f"b{i}" for i in range(150)]
    rows = [(i, " ".join(edited(base, r.choice([0, 1, 1, 2, 3, 5, 8]), r))) for i in range(700)]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 85).items()}


def test_a_template_group_of_unlinked_documents(spark):
    """5,000 documents that share a template just below the threshold, 60 pairs among them just above it: all are found."""
    r = random.Random(5)
    template = [f"t{i}" for i in range(400)]
    texts = [" ".join([*template, *(f"w{i}x{k}" for k in range(42))]) for i in range(5000)]  # 396 of 480 shingles: 0.825
    for i in range(60):
        a = texts[i].split()
        texts[5000 - 1 - i] = " ".join([*a[:-28], *(f"v{i}x{k}" for k in range(28))])  # 410 of 466: 0.88
    rows = [(i, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == {i: 4999 - i if i >= 4940 else i for i in range(5000)}


def template_group(n, seed=6):
    """n documents with 2 to 9 other words in a template of 150: few are linked, many lack the same shingles."""
    r, template, rows = random.Random(seed), [f"t{i}" for i in range(150)], []
    for i in range(n):
        words = list(template)
        for _ in range(r.randint(2, 9)):
            words[r.randrange(150)] = f"v{r.randrange(3000)}"
        rows.append((i, " ".join(words)))
    return rows


def executions(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    found = store.executionsList()
    return store, [found.apply(i).executionId() for i in range(found.size())]


def rows_made(spark, since):
    """{plan node: rows} of the joins and generators of the executions that are not in `since`."""
    store, ids = executions(spark)
    out = {}
    for x in set(ids) - set(since):
        values, nodes = store.executionMetrics(x), store.planGraph(x).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            metrics = node.metrics()
            for m in map(metrics.apply, range(metrics.size())):
                if m.name() == "number of output rows" and ("Join" in node.name() or "Generate" in node.name()):
                    value = values.get(m.accumulatorId())
                    out[x, node.id(), node.desc()[:80]] = int(value.get().replace(",", "")) if value.isDefined() else 0
    return out


def test_a_template_group_makes_few_rows(spark, tmp_path):
    """Sets and differences stay in their rows: no join and no generator makes one for each shingle of a document."""
    rows = template_group(1000)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    since = executions(spark)[1]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.read.parquet(str(tmp_path / "docs")), 85).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, 85).items()}
    made = rows_made(spark, since)
    assert len(made) > 10 and max(made.values()) <= 30 * len(rows), sorted(made.items(), key=lambda x: -x[1])[:3]


def test_a_template_group_makes_few_rows_in_the_pipeline(spark, tmp_path):
    rows = template_group(1000, 9)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    since = executions(spark)[1]
    got = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "docs")), "").collect()}
    assert got == {d for d, (_, c) in brute_components(rows, 80).items() if c == d}
    made = rows_made(spark, since)
    assert len(made) > 10 and max(made.values()) <= 40 * len(rows), sorted(made.items(), key=lambda x: -x[1])[:3]


@pytest.mark.parametrize("pivots,bits", [(3, 25), (64, 4)])
@pytest.mark.parametrize("per_cent", [80, 85])
def test_links_do_not_depend_on_the_template_or_the_counts(spark, monkeypatch, pivots, bits, per_cent):
    monkeypatch.setattr(near_dup, "PIVOTS", pivots)
    monkeypatch.setattr(near_dup, "MOST_BITS", bits)
    monkeypatch.setattr(near_dup, "LEAF", 32)
    rows = template_group(400, 7)
    groups = spark.createDataFrame([(1, i) for i, _ in rows], "node long, rep long")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    leaf, edges = near_dup.solved(groups, docs, per_cent)
    nodes = {}
    for df in leaf:
        for r in df.collect():
            nodes.setdefault(r.node, set()).add(r.rep)
    assert max(map(len, nodes.values())) <= 32
    sets = {d: brute_set(t) for d, t in rows}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= per_cent * len(sets[a] | sets[b])
    pairs = [(r.a, r.b) for df in edges for r in df.collect()]
    assert all(linked(a, b) for a, b in pairs)
    pairs += [(a, b) for m in nodes.values() for a in m for b in m if a < b and linked(a, b)]
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert label == {d: c for d, (_, c) in brute_components(rows, per_cent).items()}


@pytest.mark.parametrize("bits", [3, 20])
def test_counts_of_entries(spark, bits):
    r = random.Random(8)
    rows = [(n, r.random() < 0.3, r.sample(range(-5, 300), 20)) for n in (-7, 9) for _ in range(150)] + [(9, False, []), (9, False, [1000])]
    counts = near_dup.tally(spark.createDataFrame(rows, "node long, far boolean, diff array<long>").repartition(3), bits)
    want = {}
    for n, far, diff in rows:
        for e in diff:
            k, f = want.get((n, e), (0, False))
            want[n, e] = (k + 1, f or far)
    b = near_dup.pa.record_batch([near_dup.pa.array([n for n, _ in want], near_dup.pa.int64()), near_dup.pa.array([[e] for _, e in want], near_dup.pa.list_(near_dup.pa.int64()))], names=["node", "diff"])
    got = counts[near_dup._slots(b, bits)[0]]
    for c, (k, f) in zip(got.tolist(), want.values(), strict=True):
        assert c % 128 >= min(k, 64) and c // 128 >= f
    if bits == 20:
        assert sum(c == k + 128 * f for c, (k, f) in zip(got.tolist(), want.values(), strict=True)) > 0.99 * len(want)


@pytest.mark.parametrize("share", [0.8, 0.85])
def test_recall_of_the_trees(share):
    """The computed recall of a pair at the threshold, and a simulation of the branching, down to level 10."""
    trees, kids = near_dup.trees_for(share), 1 / share + near_dup.EXTRA
    assert near_dup.expected_recall(share, trees, 10) >= 0.995 and near_dup.expected_recall(share, trees, 24) >= 0.995
    r = np.random.default_rng(0)
    met = 0
    for _ in range(500):
        same = r.random(near_dup.WIDTH) < share
        for _ in range(trees):
            alive = int(same[r.integers(near_dup.WIDTH)])
            for _ in range(9):
                alive = int(same[r.integers(near_dup.WIDTH, size=alive + r.binomial(alive, kids - 1))].sum())
            if alive:
                met += 1
                break
    assert met >= 0.98 * 500


@pytest.mark.parametrize("per_cent", [80, 85])
def test_a_group_of_many_levels(spark, per_cent, monkeypatch):
    """3,000 documents of which any two have half their shingles in common, so that nodes halve: with leaves of 32
    documents, six levels and more. Pairs right at the threshold are among them."""
    monkeypatch.setattr(near_dup, "LEAF", 32)
    made = []
    monkeypatch.setattr(near_dup, "stash", lambda df, name, f=near_dup.stash: made.append(name) or f(df, name))
    template = [f"t{i}" for i in range(104)]  # 100 shingles
    texts = [" ".join([*template, *(f"w{i}x{k}" for k in range(60))]) for i in range(3000)]  # 160 shingles
    cut = {80: 17, 85: 12}[per_cent]  # 143 of 177: 0.81, 148 of 172: 0.86
    for i in range(100):
        texts[2999 - i] = " ".join([*texts[i].split()[:-cut], *(f"v{i}x{k}" for k in range(cut))])
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), per_cent).collect()}
    assert made.count("nodes") >= 6
    assert got == {i: 2999 - i if i >= 2900 else i for i in range(3000)}


def test_repeated_ids_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {1}
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
    c = " ".join(f"c{i}" for i in range(30))
    rows = [(1, a), (2, b), (3, c), (7, a), (7, b), (7, c)]  # an id with three sets
    assert {r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1}


def test_hot_keys_are_dealt_out(spark):
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("b", 1), ("c", 2), (None, 3)], "k string, i long")
    found = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "k string, v long")
    got = sorted((r.k, r.i, r.v) for r in workspace.spread(rows, found, "k", "i").collect())
    assert got == sorted([("a", i, 1) for i in range(50)] + [("b", 1, 2)] * 2)


def test_query_on_the_tables(spark, sf):
    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_near_dup(spark, sf).collect()}
    assert got == brute_components(rows, 85)


def test_shingle_sets_match_words():
    texts = [t for _, t in corpus(3)]
    sets = list(shingle_sets([t.encode() if t is not None else None for t in texts]))
    assert [len(s) for s in sets] == [len(brute_set(t)) for t in texts]
    assert all((sorted(s) == s.tolist()) for s in sets)
    keys = {}
    for t, s in zip(texts, sets, strict=True):
        assert keys.setdefault(brute_set(t), s.tobytes()) == s.tobytes()


def test_components(spark):
    r = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3), (5, None)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    for a, b in real:
        parent.setdefault(a, a)
        parent.setdefault(b, b)
    for _ in parent:
        for a, b in real:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert components.components(spark.createDataFrame([], "a long, b long")).isEmpty()


ARCHIVED = "<p>" + "x\r\n\r\n" * 60 + "WARC/1.1\r\n</p>"
RECORDS = [(3, "http://a/", ARCHIVED), (1, "http://b c/\r\nEvil: 1", ARCHIVED), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "é" * 50), (8, "u", "é" * 50), (8, "u", "é" * 50), (None, "u", ARCHIVED), (9, "u", "y" * 300_000), (10, "u", "z" * 200), (10, "v", "z" * 200), (None, "u", "w" * 200), (None, "v", "w" * 200)]


@pytest.mark.parametrize("broadcast", [200_000, -1])
def test_archives(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", broadcast)
    df = spark.createDataFrame([(i, u, h, "t", 0, "k") for i, u, h in RECORDS], "page_id long, url string, html string, record_type string, payload_bytes int, first string")
    path = str(tmp_path / "warc")
    warc.write(warc.records(df), path)
    got = warc.resolve(warc.read(spark, path, with_payload=True)).collect()
    want = []
    for i, _, h in RECORDS:
        raw = (h or "").encode()
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), h or ""))
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    assert sorted(((r.id, r.payload_bytes, r.payload_digest, r.payload) for r in got), key=key) == sorted(want, key=key)
    kinds = sorted((r.id or -1, r.record_type, r.refers_to or 0) for r in got)
    assert kinds == sorted([(3, "revisit", 1), (1, "response", 0), (2, "response", 0), (4, "response", 0), (5, "response", 0), (6, "response", 0), (7, "response", 0), (8, "revisit", 7), (8, "revisit", 7), (-1, "revisit", 1), (9, "response", 0), (10, "response", 0), (10, "response", 0), (-1, "response", 0), (-1, "response", 0)])
    assert {r.uri for r in got if r.id == 1} == {"http://b%20c/%20%20Evil:%201"}
    empty = str(tmp_path / "empty")
    warc.write(warc.records(df.limit(0)), empty)
    assert warc.resolve(warc.read(spark, empty)).isEmpty()


def test_archives_are_a_member_a_record(spark, tmp_path):
    import gzip
    import zlib

    df = spark.createDataFrame([(i, u, h) for i, u, h in RECORDS], "page_id long, url string, html string")
    warc.write(warc.records(df.coalesce(2)), str(tmp_path / "warc"), records_per_file=4)
    files = [f.read_bytes() for f in (tmp_path / "warc").glob("*.txt")]
    assert len(files) >= 4
    members = []
    for raw in files:
        whole = gzip.decompress(raw)
        while raw:
            d = zlib.decompressobj(31)
            members.append(d.decompress(raw) + d.flush())
            raw = d.unused_data
        assert whole.endswith(b"\r\n\r\n")
    assert sorted(len(list(warc.parse([m]))) for m in members) == [0] * len(RECORDS) + [1] * len(RECORDS)


def test_revisits_without_a_response(spark):
    rows = [(1, "u", "response", None, "d1", 5, "d1"), (2, "u", "revisit", 1, "d1", 0, "e"), (3, "u", "revisit", 9, "d9", 0, "e"), (4, "u", "revisit", 1, "other", 0, "e"), (5, "u", "revisit", None, None, 0, "e")]
    df = spark.createDataFrame(rows, "id long, uri string, record_type string, refers_to long, said_digest string, own_bytes long, own_digest string")
    got = sorted((r.id, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.resolve(df).collect())
    assert got == [(1, None, 5, "d1"), (2, 1, 5, "d1"), (3, 9, None, "d9"), (4, 1, None, "other"), (5, None, None, None)]


def test_archive_query_matches_sql(spark, sf, duck, multiset):
    assert multiset(queries.op3_warc(spark, sf).toPandas()) == multiset(duck.sql(queries.OP3_SQL).df())


def test_warc_parser_reports_damage():
    head = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\n"
    assert [p for _, p in warc.parse([head, b"ab", b"cd\r\n\r\n", head + b"\r\n\r\n\r\n\r\n"])] == [b"abcd", b"\r\n\r\n"]
    for bad in (head + b"ab", head[:20], b"HTTP/1.1 200\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse([bad]))


PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>Head &amp; line</h1><p>Some  text\n here.</p><p>x</p></article><footer>f</footer></body>", "Head & line\nSome text here.\nx"),
    ('<div id="cookie-notice">We use cookies and so on for ever and ever</div><div class="post"><p>A long paragraph of the text, which goes on.</p><p>Short</p></div><div class="comments"><p>A reader says a lot of things here, at length.</p></div>', "A long paragraph of the text, which goes on.\nShort"),
    ('<header>Site</header><main><header><h1>Title</h1></header><p>Body text that is here &#233;&eacute;.</p><form>q<input></form><aside>side</aside><script>if (a<b) x="</p>";</script></main>', "Title\nBody text that is here éé."),
    ("<p>a<br>b <b>c</b>d</p>", "a b cd"), ("plain text", "plain text"), ("<ul><li>one<li>two</ul>", "one\ntwo"), ("<article><p>cut here and the tag is bro</p><p>next <a hre", "cut here and the tag is bro\nnext"),
    ('<body class="dark"><div class="layout-with-sidebar"><article><p>The text of the article itself.</p></article><div class="sidebar"><p>Links and more links</p></div></div></body>', "The text of the article itself."),
    ('<div class="top-header">Brand</div><div class="page"><div id="content"><h2>Heading</h2><p>First part of the text is long enough to see.</p><p>Then.</p><div class="ad-box">Buy this now, it is very cheap and very good</div><p>The last part of the text is long as well.</p></div><div class="newsletter"><p>Subscribe to get our mails every day</p></div></div><div class="footer">(c)</div>', "Heading\nFirst part of the text is long enough to see.\nThen.\nThe last part of the text is long as well."),
    ("", ""), (None, ""), ("<!-- only -->", ""), ("<nav>menu</nav>", ""), ("&lt;p&gt; &amp; &copy", "<p> & ©"),
    ('<article><p>Text of the article goes here.</p><div class="share">Share</div><section id="comments"><article class="comment"><p>no</p></article></section></article>', "Text of the article goes here."),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


LONG = "This sentence of the article goes on and on for quite a while. " * 8
NAV, FOOT = "<nav><a>Home</a> <a>News</a></nav>", "<footer>Imprint</footer>"
NESTED = [
    (f"{NAV}<div id=content><h1>Title</h1><p>Lead</p><div class=body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class=part2><p>{LONG}</p></div></div>{FOOT}", ["Title", "Lead", *[LONG.strip()] * 5]),
    (f"<body>{NAV}<h1>Title</h1><p>Lead</p><blockquote>{LONG * 5}</blockquote><p>Last</p>{FOOT}</body>", ["Title", "Lead", (LONG * 5).strip(), "Last"]),
    (f"<body>{NAV}<section><h2>One</h2><pre>{LONG * 5}</pre></section><section><h2>Two</h2><p>{LONG}</p><p>End</p></section>{FOOT}</body>", ["One", (LONG * 5).strip(), "Two", LONG.strip(), "End"]),
    (f"<div>First</div><p>{LONG}</p><p>{LONG}</p><div>Last</div>", ["First", *[LONG.strip()] * 2, "Last"]),
]


@pytest.mark.parametrize("html,texts", NESTED)
def test_main_text_without_an_article_element(html, texts):
    assert html_text.main_text(html).split("\n") == texts


SHORT = "<p>One short paragraph of the text.</p><p>And another one, to end it.</p>"
TEXT = "One short paragraph of the text.\nAnd another one, to end it."
NAMED = [
    f'<body class="single comments-open">{NAV}{SHORT}{FOOT}</body>',
    f'<article class="post comments-open">{SHORT}</article>',
    f'<body><form id="aspnetForm">{NAV}{SHORT}<input><button>Go</button>{FOOT}</form></body>',
    f'<body>{NAV}<div id="share-price-analysis">{SHORT}</div>{FOOT}</body>',
    f'<body>{NAV}<div class="cookie-recipe">{SHORT}</div>{FOOT}</body>',
    f"<body><nav><a>Home</a> <a>News</a><div>{SHORT}</div></body>",
    f"<body><div><a>Home</a> <a>News</a> <a>Sport</a></div>{SHORT}<div>(c) 2024 Site</div></body>",
    f"<body><div><a>Home</a> <a>News</a> <a>Sport</a></div>{SHORT * 3}<div>(c) 2024 Site</div></body>",
    f'<body>{SHORT}<div class="acme-sidebar"><p>{LONG}</p></div><section id="comments"><p>{LONG * 3}</p></section></body>',
    f'<body><div class="cookie-notice"><p>{LONG}</p></div><main>{SHORT}<div class="newsletter-box">Mail me</div></main></body>',
    '<body><p>One short <button>Share</button>paragraph of the text.</p><p>And another one, <span class="ad">buy</span>to end it.</p></body>',
]


def test_teasers_are_no_article():
    cards = "".join(f"<article><h3>Card {i}</h3><p>More to read.</p></article>" for i in range(3))
    assert html_text.main_text(f"<body>{NAV}<div id=story><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>{cards}{FOOT}</body>").startswith("Title\n" + LONG.strip())


@pytest.mark.parametrize("page", NAMED)
def test_names_do_not_empty_a_page(page):
    assert html_text.main_text(page) in (TEXT, "\n".join([TEXT] * 3))


def test_nesting_is_linear():
    import time

    times = []
    for depth in (10_000, 40_000):
        began = time.process_time()
        assert html_text.main_text("<div>" * depth + "<p>deep text</p>" + "</b>" * depth) == "deep text"
        times.append(time.process_time() - began)
    assert times[1] < 10 * times[0]


def test_main_text_table(spark):
    rows = [(i, f"u{i}", h, "t", 7) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>", "t", 1), (1, "u1", PAGES[1][0], "t", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id is not None) == sorted([(i, t, len(t)) for i, (_, t) in enumerate(PAGES)] + [(1, PAGES[1][1], len(PAGES[1][1]))])
    deep = "<div>" * 3000 + "<p>deep text in many boxes</p>"
    assert html_text.main_text(deep) == "deep text in many boxes" and len(html_text.main_text("<p>" + "word " * 100_000)) == 499_999


def test_main_text_of_the_tables(spark, sf):
    import html
    import re

    pages = {r.page_id: r.html for r in queries.table(spark, sf, "pages").collect()}
    for r in queries.op5_main_text(spark, sf).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_top_k(spark):
    r = np.random.default_rng(0)
    vecs = [[float(x) for x in r.normal(size=8)] for _ in range(60)] + [[0.0] * 8, [], [1.0] * 3]
    rows = [(i, v) for i, v in enumerate(vecs)] + [(100, None), (101, [1.0, None]), (102, [float("nan")] * 8), (103, [float("inf")] * 8), (None, [1.0] * 8), (0, vecs[0]), (110, vecs[5]), (111, vecs[5])]
    df = spark.createDataFrame([(i, v, "s", 0) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    got = topk.top_k(df, F.col("vec_id") % 10 == 0, k=5).collect()
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in {i: v for i, v in whole if i % 10 == 0}.items():
        want = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in whole if i != q))[:5]
        assert [(-x.score, x.id) for x in sorted((y for y in got if y.query_id == q), key=lambda y: y.rank)] == want
    assert topk.top_k(df.where("vec_id < 3"), F.col("vec_id") == 1, k=5).count() == 3
    assert topk.top_k(df.limit(0), F.lit(True)).isEmpty() and topk.top_k(df, F.lit(False)).isEmpty()


def test_top_k_query_matches_sql(spark, sf, duck, multiset):
    assert multiset(queries.op6_top_k(spark, sf).toPandas()) == multiset(duck.sql(queries.OP6_SQL).df())


def test_sparse_and_dense_accumulation():
    r = np.random.default_rng(1)
    for share in (0.0, 0.5, 0.9, 1.0):
        q, c = r.integers(-9, 9, (6, 20)), r.integers(-9, 9, (30, 16))
        q[r.random(q.shape) < share] = 0
        c[r.random(c.shape) < share] = 0
        post = lambda m, a=0, z=None: topk.Postings(np.arange(len(m) + 1) * m.shape[1], m.ravel(), a, z)
        assert (topk.accumulate(post(q), post(c)) == q[:, :16] @ c.T).all()
        assert (topk.accumulate(post(q, 2, 5), post(c)) == q[2:5, :16] @ c.T).all()
        lists = post(c)
        assert sum(len(lists.of(k)[0]) for k in range(len(lists.terms))) == np.count_nonzero(c)


def test_top_k_by_either_join(spark, sf, duck, multiset, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 2)
    monkeypatch.setattr(topk, "SCORE_ROWS", 1)
    want = multiset(duck.sql(queries.OP6_SQL).df())
    for limit in (1 << 26, -1):
        monkeypatch.setattr(topk, "BROADCAST_BYTES", limit)
        assert multiset(queries.op6_top_k(spark, sf).toPandas()) == want


def picture(seed, h=90, w=70):
    r = np.random.default_rng(seed)
    return np.kron(r.integers(0, 255, (h // 5, w // 5)), np.ones((5, 5))).astype(np.uint8)


def test_copied_images(spark):
    a, b = picture(1), picture(2)
    edit = a.copy()
    edit[30:45, 20:40] = 128
    images = {1: a, 2: b, 3: a[15:80, 10:65], 4: edit, 5: b[:, 8:], 6: picture(3), 7: a, 8: np.zeros((4, 4), np.uint8), 9: np.zeros((4, 4), np.uint8), 10: np.clip(a.astype(int) + 12, 0, 255).astype(np.uint8)}
    rows = [(i, media.encode_pgm(p), "x", 0, "d") for i, p in images.items()] + [(20, None, "x", 0, "d"), (21, b"no image", "x", 0, "d"), (22, b"P5 9 9 255\nshort", "x", 0, "d"), (None, media.encode_pgm(a), "x", 0, "d"), (6, media.encode_pgm(images[6]), "x", 0, "d")]
    df = spark.createDataFrame(rows, "id long, image binary, features string, n int, digest string").withColumnRenamed("id", "image_id")
    got = media.copies(df, "image_id", "image").collect()
    assert len(got) == len(rows)
    assert {r.image_id: r.component_id for r in got if r.image_id is not None} == {1: 1, 3: 1, 4: 1, 7: 1, 10: 1, 2: 2, 5: 2, 6: 6, 8: 8, 9: 8, 20: 20, 21: 21, 22: 22}
    assert {r.image_id: r.copied for r in got if r.image_id in (1, 2, 6, 8, 20)} == {1: True, 2: True, 6: False, 8: True, 20: False}
    assert media.copies(df.limit(0), "image_id", "image").isEmpty()


def box(a, times):
    for _ in range(times):
        a = sum(np.roll(a, (y, x), (0, 1)) for y in (-1, 0, 1) for x in (-1, 0, 1)) / 9
    return a


def photo(seed, h=160, w=200):
    """Soft ground at three scales, and shapes with edges and shades of their own."""
    r = np.random.default_rng(seed)
    out = np.full((h, w), 128.0)
    for times, contrast in ((1, 15), (3, 30), (12, 60)):
        ground = box(r.normal(size=(h, w)), times)
        out += contrast * ground / ground.std()
    for _ in range(14):
        y, x, high, wide = r.integers(0, h - 20), r.integers(0, w - 20), r.integers(8, 40), r.integers(8, 40)
        out[y : y + high, x : x + wide] = out[y : y + high, x : x + wide] * 0.4 + r.integers(20, 200)
    return np.clip(out, 0, 255).astype(np.uint8)


def turned(im, degrees):
    h, w = im.shape
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[0 : int(h * c + w * s), 0 : int(w * c + h * s)]
    x, y = x - x.shape[1] / 2, y - x.shape[0] / 2
    u, v = x * c + y * s + w / 2, y * c - x * s + h / 2
    i, j = np.clip(v.astype(int), 0, h - 2), np.clip(u.astype(int), 0, w - 2)
    fy, fx, im = np.clip(v - i, 0, 1), np.clip(u - j, 0, 1), im.astype(float)
    mixed = (im[i, j] * (1 - fx) + im[i, j + 1] * fx) * (1 - fy) + (im[i + 1, j] * (1 - fx) + im[i + 1, j + 1] * fx) * fy
    return np.where((u < 0) | (v < 0) | (u > w - 1) | (v > h - 1), 0, mixed).astype(np.uint8)


def noisy(im, sd, r):
    return np.clip(im + r.normal(0, sd, im.shape), 0, 255).astype(np.uint8)


def covered(im):
    out = im.copy()
    out[40:80, 30:150] = 255
    return out


def part(im, size, r):
    y, x = r.integers(0, im.shape[0] - size), r.integers(0, im.shape[1] - size)
    return im[y : y + size, x : x + size]


EDITS = {
    "crop of 50": lambda im, r: part(im, 50, r),
    "crop of 100": lambda im, r: part(im, 100, r),
    "noise": lambda im, r: noisy(im, 10, r),
    "crop with noise": lambda im, r: noisy(part(im, 100, r), 3, r),
    "overlay": lambda im, r: covered(im),
    "darker": lambda im, r: (255 * (im / 255) ** 1.6).astype(np.uint8),
    "lighter": lambda im, r: (255 * (im / 255) ** 0.6).astype(np.uint8),
    "quarter turn": lambda im, r: np.rot90(im),
    "half turn": lambda im, r: np.rot90(im, 2),
    "turn": lambda im, r: turned(im, 30),
    "half size": lambda im, r: box(im.astype(float), 1)[::2, ::2].astype(np.uint8),
}


def test_edited_images_are_found(spark):
    """Of 20 pictures and one copy with each edit, nine in ten copies at least are found, and no other pair."""
    images, ids = [], {}
    for seed in range(20):
        im, r = photo(seed), np.random.default_rng(seed)
        ids[seed, None] = len(images)
        images.append(im)
        for name, edit in EDITS.items():
            ids[seed, name] = len(images)
            images.append(edit(im, r))
    df = spark.createDataFrame([(i, media.encode_pgm(p)) for i, p in enumerate(images)], "id long, image binary").repartition(8)
    got = {r.id: r.component_id for r in media.copies(df, "id", "image").collect()}
    for name in EDITS:
        assert sum(got[ids[s, name]] == ids[s, None] for s in range(20)) >= 18, name
    assert all(got[ids[s, None]] == ids[s, None] for s in range(20))


def test_a_small_crop_of_a_large_image(spark):
    """Crops of one to three hundredths of the area meet their original among others."""
    images = {s: photo(s, 500, 600) for s in range(4)}
    for s in range(4):
        for k, size in enumerate((55, 70, 95)):
            images[10 + 3 * s + k] = part(images[s], size, np.random.default_rng(s + 50 * k))
    df = spark.createDataFrame([(i, media.encode_pgm(p)) for i, p in images.items()], "id long, image binary")
    got = {r.id: r.component_id for r in media.copies(df, "id", "image").collect()}
    assert sum(got[10 + 3 * s + k] == s for s in range(4) for k in range(3)) >= 11 and all(got[s] == s for s in range(4))


def test_entries_of_many_images(spark, monkeypatch):
    """Entries of more images than a leaf holds branch on the corners around, or are dealt around two of their images."""
    monkeypatch.setattr(media, "LEAF", 8)
    stamp = photo(1, 60, 60)  # all pictures show it, but it is no fifth of any
    images = {}
    for s in range(40):
        im = photo(100 + s)
        im[40:70, 50:80] = stamp[:30, :30]
        images[s] = im
    for s in range(20):
        images[100 + s] = part(images[s], 110, np.random.default_rng(s))
    for s in range(40):  # and one that has forty copies
        images[200 + s] = noisy(photo(2), 2 + s % 3, np.random.default_rng(s))
    df = spark.createDataFrame([(i, media.encode_pgm(p)) for i, p in images.items()], "id long, image binary").repartition(8)
    got = {r.id: r.component_id for r in media.copies(df, "id", "image").collect()}
    assert all(got[200 + s] == 200 for s in range(40)) and all(got[s] == s for s in range(40))
    assert sum(got[100 + s] == s for s in range(20)) >= 18


def test_a_large_entry_loses_no_copy(spark, monkeypatch):
    """Copies whose corners meet in one entry only, which very many images share, are found whatever is around the corners."""
    monkeypatch.setattr(media, "LEAF", 8)
    one = lambda images: images.select(F.lit(5).cast("long").alias("node"), "rep", F.lit(0).cast("long").alias("corner"), F.expr("substring(corners, 13, 16)").alias("seen"))
    monkeypatch.setattr(media, "entries", one)
    images = {0: photo(50), 1: photo(51, 60, 60)}  # the smallest id and the fewest corners
    for s in range(15):
        images[10 + s] = photo(60 + s)
        images[40 + s] = noisy(images[10 + s], 8, np.random.default_rng(s))
    images[70] = noisy(part(images[12], 100, np.random.default_rng(1)), 3, np.random.default_rng(2))
    df = spark.createDataFrame([(i, media.encode_pgm(p)) for i, p in images.items()], "id long, image binary").repartition(8)
    got = {r.id: r.component_id for r in media.copies(df, "id", "image").collect()}
    assert got == {0: 0, 1: 1, 70: 12} | {10 + s: 10 + s for s in range(15)} | {40 + s: 10 + s for s in range(15)}


def test_comparison_in_blocks(monkeypatch):
    im = photo(3)
    a, b = media.features([im])[0], media.features([np.ascontiguousarray(np.rot90(im))])[0]
    whole = media.votes(a, b)
    monkeypatch.setattr(media, "AT_ONCE", 1000)
    assert media.votes(a, b) == whole >= 0.9 * len(a)
    small = [photo(s, 60, 80) for s in range(5)]
    assert all((x == media.features([p])[0]).all() for x, p in zip(media.features(small), small, strict=True))


def test_images_against_all_pairs(spark, sf):
    """Each pair of pages that the full comparison calls a copy is in one component, and no other."""
    pages = queries.table(spark, sf, "pages").select("page_id", "html").collect()
    pics = {r.page_id: media.decode_pgm(media.render(r.html)) for r in pages}
    found = dict(zip(pics, media.features(list(pics.values())), strict=True))
    parent = {i: i for i in pics}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(pics)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            same = pics[i].shape == pics[j].shape and (pics[i] == pics[j]).all()
            if same or media.is_copy(found[j], found[i]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert {r.page_id: r.component_id for r in queries.op1_media_copies(spark, sf).collect()} == {i: root(i) for i in ids}


def test_pipeline(spark, sf):
    docs = queries.table(spark, sf, "documents")
    columns = docs.columns
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, sf, "labels").collect()}
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in kept.select("doc_id").collect()}
        out = stage(spark, kept, sf)
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == before
            break
        assert out.columns == columns
        out = spark.createDataFrame(out.collect(), out.schema)
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and all(r.text == texts[r.doc_id] for r in out.select("doc_id", "text").collect())
        if name == "toxicity":
            assert sum(labels.get(d) == 0 for d in before - after) <= 0.1 * len(before)
        if name == "near_dup":
            groups = brute_components([(d, texts[d]) for d in sorted(before)], 80)
            assert after == {d for d, (n, c) in groups.items() if d == c}
        kept = out
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_stages_on_other_columns(spark, sf):
    """Columns that an operator makes itself are dropped, missing ones are null, empty tables stay empty."""
    docs = queries.table(spark, sf, "documents").limit(60).drop("source", "n_chars").withColumns({"p_toxic": F.lit("x"), "score": F.lit(1), "kept": F.lit(False), "gap": F.lit("g"), "rep": F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.where("source is not null or n_chars is not null").isEmpty()
        assert out.count() > 0 and stage(spark, docs.limit(0), sf).isEmpty()


def test_stages_document_by_document(spark, sf):
    """What the first two stages keep, against their models asked for one text at a time."""
    docs = queries.table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    chain = queries.toxicity_chain(docs, queries.table(spark, sf, "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, sf).collect()}
    assert kept == {d for d, t in texts.items() if chain.predict([t])[0, -1] < queries.TOXIC_FROM}
    model = language.fit(docs)
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, docs, sf).collect()}
    judged = {d: [x[0] for x in model.judge([t])] for d, t in texts.items()}
    assert kept == {d for d, (x, score, gap) in judged.items() if x != "und" and score >= corpus_pipeline.CERTAIN_FROM and gap <= corpus_pipeline.USUAL_TO}


def test_pipeline_drops_what_is_no_learned_language(spark, sf):
    r = random.Random(6)
    junk = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)) for n in (10, 30, 100)]
    junk += ["Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "Все люди рождаются свободными и равными в своем достоинстве и правах"]
    docs = queries.table(spark, sf, "documents")
    rows = spark.createDataFrame([(-1 - i, t, None, "junk", len(t)) for i, t in enumerate(junk)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x.doc_id for x in corpus_pipeline.keep_languages(spark, docs.union(rows.select(docs.columns)), sf).select("doc_id").collect()}
    assert kept == {x.doc_id for x in docs.select("doc_id").collect()}


def test_pipeline_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "123", None, "s", 3), (None, "the cat and the dog of the house", "en", "s", 9), (5, "the cat and the dog of the house", "en", "s", 9), (6, "the cat and the dog of the house", "en", "s", 9)], schema)
    for stage in (odd, odd.limit(0)):
        kept = stage
        for _, f in corpus_pipeline.STAGES[:-1]:
            kept = f(spark, kept, sf)
        ids = [r.doc_id for r in kept.collect()]
        assert ids == [] or sorted(i or 0 for i in ids) == [0, 5]
        corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()


def test_garbage_is_given_back(spark):
    """What earlier steps left on the heap is collected, so it does not stay until the heap is full."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    used = lambda: heap.totalMemory() - heap.freeMemory()
    held = [spark.sparkContext._gateway.new_array(spark._jvm.long, 2_000_000) for _ in range(4)]
    before = used()
    del held
    workspace.give_back(spark)
    assert used() < before - 50_000_000


def test_broadcasts_are_bounded(spark, monkeypatch):
    """More ids than go to every task are joined by a shuffle, of the texts that are looked up only; the result is the same."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i // 2) * 40 + k}" for k in range(39 + i % 2))) for i in range(60)], "doc_id long, text string")
    rows = spark.createDataFrame([(7, i) for i in range(0, 60, 3)], "node long, rep long")
    want = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()}
    assert want == {(i, i - i % 2) for i in range(60)}
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 10)
    found = near_dup.shingles_of(rows, docs)
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.node, r.rep, len(r.set)) for r in found.collect()} == {(7, i, 35 + i % 2) for i in range(0, 60, 3)}
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()} == want
