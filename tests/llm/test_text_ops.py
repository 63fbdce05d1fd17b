"""Token counts, packing, SentencePiece, language, toxicity: against the libraries and on odd tables."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from sparrowdex.llm import language, packing, pieces, queries, spm, token_counts, toxicity  # noqa: E402

PATH, SPM = queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "Hello, World!", "it's we'll 'S x'd", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "É́cole İstanbul ΣΑΣ ß ǆ", "a b c d", "x\x1cy\x1fz\x85w", "漢字 かな 123 ½ ²", "word. word.. end!?", "é", "1.5,2;3", "\x00\x01", "🙂🙃 ok", "a" * 5000, "the " * 3000]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def frame(spark, texts):
    """Texts with ids, a repeated row, a null id, and columns whose names an operator might use itself."""
    rows = [(i, t, "x", 1, b"", "q") for i, t in enumerate(texts)] + [(0, texts[0], "y", 2, b"", "r"), (None, "no id", "z", 3, b"", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int, digest binary, rep string")


def test_counts_are_the_library_s(spark, library):
    got = token_counts.token_counts(frame(spark, ODD), PATH, limit=10, with_table=True).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        text = "no id" if r.doc_id is None else ODD[r.doc_id]
        assert r.n_tokens == len(library(text)) and r.n_bytes == len((text or "").encode()) and r.over_limit == (r.n_tokens > 10)
        assert len(r.prefix_tokens) == len(text or "") + 1 and r.prefix_tokens[-1] == r.n_tokens
    assert token_counts.token_counts(frame(spark, ODD).limit(0), PATH).isEmpty()


def test_counts_of_the_tables(spark, sf, library):
    """The query against the library, text by text."""
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()}
    got = queries.op8_token_counts(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), n, n > 2048)


def by_prefix(text, library):
    return [len(library(text[:k])) for k in range(len(text) + 1)]


def test_every_prefix_of_odd_texts(library):
    for text in [*ODD, "they'RE we'll'd ''s 'v 'l ...'re 'r", "ÅÅ Ǆemal ﬁ ½¾ ①② e̊a", "ab<|endoftext|>cd<|endoftext <|startoftext|>", "สวัสดีครับ नमस्ते 한국어 각 각", " x y​z", "=≠ ≮"]:
        text = (text or "")[:150]
        assert token_counts.prefix_table(text, PATH).tolist() == by_prefix(text, library)


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(alphabet=st.sampled_from("abcéİΣσ 'strevldmS.\n,12漢<|>-_́ "), max_size=40), st.text(max_size=25), st.lists(st.sampled_from(["the", "ing", "<|endoftext|>", "'re", "un", "Wonder", "...", " "])).map("".join)))
def test_every_prefix(text):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(PATH)
    library = lambda x: loaded.encode(x, add_special_tokens=False).ids
    table, want = token_counts.prefix_table(text, PATH), by_prefix(text, library)
    assert table.tolist() == want
    for k in range(len(text) + 2):
        assert token_counts.count_at(table, k) == want[min(k, len(text))]
    for budget in range(max(want) + 2):
        assert token_counts.truncate_at(table, budget) == max(k for k, n in enumerate(want) if n <= budget)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 200), max_size=40), st.sampled_from([16, 64]))
def test_windows_hold_each_token_once(lengths, capacity):
    lengths = [n for n in lengths if n]
    out = packing.windows(lengths, capacity)
    seen = sorted((d, s, n) for w in out for d, s, n in w)
    for d, size in enumerate(lengths):
        at = 0
        for _, s, n in (p for p in seen if p[0] == d):
            assert s == at and n > 0
            at += n
        assert at == size
    assert all(0 < sum(p[2] for p in w) <= capacity for w in out)


def test_differencing_balances():
    r = random.Random(1)
    sizes = [r.randint(1, 1000) for _ in range(400)]
    bins = packing.difference(sizes, 20)
    sums = [sum(sizes[i] for i in b) for b in bins]
    assert sorted(i for b in bins for i in b) == list(range(400)) and max(sums) - min(sums) <= 10
    assert packing.difference([], 3) == [[], [], []] and packing.difference([5], 1) == [[0]]


def test_packing_round_trip(spark, library):
    docs = frame(spark, [*ODD, "long " * 6000])
    got = packing.pack(docs, PATH, capacity=64, end_id=2, with_ids=True).collect()
    pieces_of: dict = {}
    for r in got:
        pieces_of.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for i, t in enumerate([*ODD, "long " * 6000]):
        rows = sorted(pieces_of[i], key=lambda r: r.start)
        copies = 2 if i == 0 else 1  # the first row is there twice
        ids = [x for r in rows for x in r.ids]
        assert sorted(ids) == sorted((library(t) + [2]) * copies) and (copies == 2 or ids == library(t) + [2])
        assert all(r.doc_tokens == len(library(t)) + 1 for r in rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for rows in by.values():
        rows.sort(key=lambda r: r.offset)
        fill = 0
        for r in rows:
            assert r.offset == fill
            fill += r.length
        padding += 0 if fill & (fill - 1) == 0 else 64 - fill
    assert padding <= 0.25 * sum(r.length for r in got) and packing.pack(docs.limit(0), PATH).isEmpty()


def test_query_packs_with_little_padding(spark, sf):
    got = queries.op9_packing(spark, sf).groupBy("sequence_id").agg(F.sum("length").alias("n")).toPandas()["n"]
    assert got.max() <= 4096 and sum(4096 - n for n in got if n & (n - 1)) <= 0.01 * got.sum()


def test_spm_is_the_library_s(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    texts = [*ODD, "▁a ▁▁b", "  two  spaces ", "tab\tand\nline\n\nfeeds", "<s>x</s><unk>"]
    got = {r.doc_id: r for r in spm.encode(frame(spark, texts), SPM, with_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = sp.encode(t or "")
        assert (got[i].ids or []) == ids and got[i].n_tokens == len(ids) and got[i].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert got[i].round_trip or "▁" in t
    back = spm.decode(spm.encode(frame(spark, texts), SPM, with_ids=True), SPM).collect()
    assert {r.doc_id: r.text for r in back if r.doc_id is not None and "▁" not in (texts[r.doc_id] or "")} == {i: t or "" for i, t in enumerate(texts) if "▁" not in (t or "")}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdehilnorst  eE.\n,é漢_-0123<s>"), max_size=60))
def test_spm_on_any_text(text):
    import sentencepiece

    ids, _ = spm.model(SPM).encode(pa.array([text]))
    assert ids.tolist() == _sp(sentencepiece).encode(text)


_cached: list = []


def _sp(module):
    if not _cached:
        _cached.append(module.SentencePieceProcessor(model_file=SPM))
    return _cached[0]


def test_unigram_viterbi_is_the_best_path():
    """A unigram model's forward states against all segmentations."""
    m = spm.Model.__new__(spm.Model)
    m.bpe, m.scores = False, {"a": -1.0, "b": -1.5, "ab": -2.0, "abc": -2.2, "c": -3.0, "bc": -0.5, "▁": -0.1, "▁a": -0.4}
    m.lengths = spm.piece_lengths(m.scores)

    def best(s):
        options = [(0.0, [])] if not s else []
        for k in range(1, len(s) + 1):
            if s[:k] in m.scores:
                rest = best(s[k:])
                if rest:
                    options.append((m.scores[s[:k]] + rest[0], [s[:k], *rest[1]]))
        return max(options, key=lambda x: x[0]) if options else None

    units = sorted({"▁" + "".join(random.Random(i).choice("abc") for _ in range(6)) for i in range(30)})
    for u, got in zip(units, m.encode_sorted(units), strict=True):
        assert abs(sum(m.scores[p] for p in got) - best(u)[0]) < 1e-9 and "".join(got) == u


def test_language(spark):
    r = random.Random(0)
    words = {"en": "the of and that with from this have not are".split(), "de": "der die und nicht mit von das ist auch ein".split(), "fr": "le la les des et que une pour dans est".split()}
    rows = [(i, " ".join(r.choices(words[k], k=30)), k) for i in range(300) for k in [("en", "de", "fr")[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = language.identify(frame(spark, [None, "", "123 --- 456", "the and of", "der nicht", "que les des", "the " * 20000]), model).orderBy("doc_id").collect()
    assert [(x.lang_pred, x.score) for x in got if x.doc_id is not None and x.doc_id < 3] == [("und", 0.0)] * 4
    assert [x.lang_pred for x in got if x.doc_id is not None and x.doc_id >= 3] == ["en", "de", "fr", "en"] and all(0 <= x.score <= 1 for x in got)
    nothing = language.fit(docs.limit(0))
    assert [x.lang_pred for x in language.identify(docs.limit(2), nothing).collect()] == ["und", "und"]
    assert language.fit(docs, sample_rows=60).languages == ["de", "en", "fr"] and language.identify(docs.limit(0), model).isEmpty()


MASK = (1 << 64) - 1


def grams_by_hand(text):
    """The buckets of a text's n-grams: one to four characters of a word between two marks, not the mark alone."""
    out = []
    word = ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
            continue
        marked = f" {word} "
        for n in language.ORDERS if word else ():
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if g.strip():
                    h = 0
                    for x in g:
                        h = (h * 0x9E3779B97F4A7C15 + (ord(x) + 1) * 0xC2B2AE3D27D4EB4F) & MASK
                    h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK
                    out.append(h >> (65 - language.BUCKETS.bit_length()))
        word = ""
    return sorted(out)


def test_language_grams_by_hand():
    """The vectorised n-grams of several texts are those of each text, counted one by one."""
    texts = ["Ab c!", None, "", "déf--gh", "x", "Straße 漢字", "a" * 300, "İstanbul o'clock", " \n"]
    bucket, owner, has = language.grams(texts)
    for i, t in enumerate(texts):
        assert sorted(bucket[owner == i].tolist()) == grams_by_hand(t)
        assert has[i] == any(c.isalpha() for c in (t or "").lower())


def test_languages_by_hand(spark, sf):
    """The query against naive Bayes that counts and multiplies document by document."""
    from collections import Counter
    from math import exp, log

    rows = [tuple(r) for r in queries.table(spark, sf, "documents").select("doc_id", "text", "lang").collect()]
    known = [(t, x) for d, t, x in rows if t is not None and x is not None and zlib.crc32(str(d).encode()) % 5]
    langs = sorted({x for _, x in known})
    counts, seen = {x: Counter() for x in langs}, Counter(x for _, x in known)
    for t, x in known:
        counts[x].update(grams_by_hand(t))
    whole = {x: sum(c.values()) + 0.5 * language.BUCKETS for x, c in counts.items()}
    got = {r.doc_id: r for r in queries.op10_language_id(spark, sf).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        r = got[d]
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        own = Counter(grams_by_hand(t))
        logs = {x: log(seen[x] / len(known)) + sum(n * (log(counts[x][g] + 0.5) - log(whole[x])) for g, n in own.items()) for x in langs}
        best = max(logs, key=logs.get)
        assert r.lang_pred == best and abs(r.score - 1 / sum(exp(v - logs[best]) for v in logs.values())) < 1e-6


def test_held_out_accuracy(spark, sf):
    got = queries.op10_language_id(spark, sf).join(queries.table(spark, sf, "documents"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_toxicity_chain(spark):
    r = random.Random(5)
    clean, bad = [f"w{i}" for i in range(200)], ["awful1", "awful2", "awfulx"]
    rows = []
    for i in range(1500):
        t = r.choices(clean, k=40)
        if i % 5 == 0:
            t[r.randrange(40)] = r.choice(bad)
        low = i % 3 == 0
        rows.append((i, " ".join(t + ["spam"] * low), int(low), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, a, b) for i, _, a, b in rows if i < 1200] + [(None, 1, 1), (10**9, 1, 1)], "doc_id long, low int, toxic int")
    chain = toxicity.fit(docs, labels, ["low", "toxic"])
    got = {x.doc_id: x for x in toxicity.score(docs, chain).collect()}
    unseen = [x for x in rows if x[0] >= 1200]
    assert all((got[i].p_toxic >= 0.5) == bool(b) for i, _, _, b in unseen) and all((got[i].p_low >= 0.5) == bool(a) for i, _, a, _ in unseen)
    odd = toxicity.score(frame(spark, [None, "", "awful1 " * 30000]), chain).collect()
    assert len(odd) == 5 and {x.p_toxic >= 0.5 for x in odd if x.doc_id == 2} == {True}
    empty = toxicity.fit(docs, labels.limit(0), ["low", "toxic"])
    assert {round(x.p_toxic, 3) for x in toxicity.score(docs.limit(3), empty).collect()} == {0.5}


def features_by_hand(text):
    """The buckets of a text's words and of the beginnings of its words."""
    found, word = set(), ""
    for c in (text or "").lower() + "\n":
        if c.isalpha():
            word += c
            continue
        for kind, n in ((0, None), *enumerate(toxicity.BEGINNINGS, 1)):
            if word and (n is None or len(word) > n):
                h, power = 0, 1
                for x in word[:n]:
                    power = power * 0x9E3779B97F4A7C15 & MASK
                    h = (h + (ord(x) + 1) * power) & MASK
                # the hash begins with the power of the first letter's place
                h = (h * pow(0x9E3779B97F4A7C15, -1, 1 << 64) + kind * 0x9E3779B97F4A7C15) & MASK
                h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & MASK
                found.add(h >> 44)
        word = ""
    return found


def test_word_features_by_hand():
    for t in ["One two two threefold", None, "", "Zwölf-fünfzig o'clock", "a" * 200, "漢字 x1y"]:
        row, bucket = toxicity.word_features([t])
        assert not row.any() and sorted(bucket.tolist()) == sorted(features_by_hand(t))


def plain_fit(x, d, y, ridge=0.3, steps=200):
    """Logistic regression on dense rows: the same descent, matrix by matrix."""
    z = np.column_stack([x, d, np.ones(len(x))])
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    rate = 1 / (0.25 * (weight * (z**2).sum(1)).sum() + ridge / len(y))
    w = v = np.zeros(z.shape[1])
    t, keep = 1.0, np.append(np.full(z.shape[1] - 1, ridge / len(y)), 0)
    for _ in range(steps):
        g = z.T @ (weight * (1 / (1 + np.exp(-np.clip(z @ v, -60, 60))) - y)) + keep * v
        new, before = v - rate * g, t
        t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v = new, new + (before - 1) / t * (new - w)
    return lambda x, d: 1 / (1 + np.exp(-(np.column_stack([x, d, np.ones(len(x))]) @ w)))


def test_the_chain_fold_by_fold(spark, sf):
    """The query against a chain of dense models, its features counted text by text and its folds fitted one by one."""
    docs = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    labels = {r.doc_id: (1 - r.quality, r.toxic) for r in queries.table(spark, sf, "labels").collect() if r.quality is not None and r.toxic is not None}
    ids = sorted(d for d in labels if d in docs)
    have = {d: features_by_hand(t) for d, t in docs.items()}
    y = np.array([labels[d] for d in ids], float)
    n0, n1 = {}, [{}, {}]
    for d in ids:
        for f in have[d]:
            n0[f] = n0.get(f, 0) + 1
            for j in (0, 1):
                n1[j][f] = n1[j].get(f, 0) + labels[d][j]
    size, positive = len(ids), y.sum(0)

    def gap(f, j):
        p = positive[j]
        away = abs(n1[j][f] / max(p, 1) - (n0[f] - n1[j][f]) / max(size - p, 1))
        return away / ((n0[f] + 1) / ((size + 2) * max(min(p, size - p), 1))) ** 0.5

    rated = sorted(((-max(gap(f, 0), gap(f, 1), 0.0), f) for f, n in n0.items() if n >= 3))
    chosen = sorted(f for _, f in rated[: toxicity.FEATURES])
    matrix = lambda some: np.array([[float(f in have[d]) for f in chosen] for d in some])
    x, fold = matrix(ids), np.random.default_rng(3).permutation(size) % toxicity.FOLDS
    none, unseen = np.zeros((size, 0)), np.zeros(size)
    for f in range(toxicity.FOLDS):
        unseen[fold == f] = plain_fit(x[fold != f], none[fold != f], y[fold != f, 0])(x[fold == f], none[fold == f])
    first = plain_fit(x, none, y[:, 0])
    second = plain_fit(x, toxicity.logit(unseen[:, None]), y[:, 1])
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    assert len(got) == len(docs)
    some = sorted(docs)
    p0 = first(matrix(some), np.zeros((len(some), 0)))
    p1 = second(matrix(some), toxicity.logit(p0[:, None]))
    for d, a, b in zip(some, p0, p1, strict=True):
        assert abs(got[d].p_low_quality - a) < 1e-6 and abs(got[d].p_toxic - b) < 1e-6 and got[d].toxic == (got[d].p_toxic >= queries.TOXIC_FROM)


def test_toxic_documents_that_were_not_learned_from(spark):
    """Half of the labels of a larger table teach the chain, the other half judges it."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no larger tables here")
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    chain = queries.toxicity_chain(docs, labels.where("doc_id % 2 = 0"))
    got = toxicity.score(docs, chain).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    found = got.p_toxic >= queries.TOXIC_FROM
    assert found[got.toxic == 1].mean() >= 0.8 and found[got.toxic == 0].mean() <= 0.05


def test_null_labels_say_nothing(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} bad" if i % 2 else f"w{i % 7} good") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2, i % 2) for i in range(50)]
    known = spark.createDataFrame(labels, "doc_id long, low int, toxic int")
    more = spark.createDataFrame([*labels, (51, None, 0), (53, 0, None), (55, None, None), (None, 1, 1)], "doc_id long, low int, toxic int")
    a, b = (sorted((r.doc_id, round(r.p_toxic, 9)) for r in toxicity.score(docs, toxicity.fit(docs, x, ["low", "toxic"])).collect()) for x in (known, more))
    assert a == b


def test_sentencepiece_of_the_tables(spark, sf):
    """The query against the library, text by text."""
    import sentencepiece

    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    got = queries.op7_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts) and spm.kind_of(SPM) == "bpe"
    for r in got:
        ids = _sp(sentencepiece).encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_of_the_tables(spark, sf, library):
    """The query's pieces put together are the library's ids of each text, and fill their sequences without gaps."""
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.op9_packing(spark, sf).toPandas()
    assert set(rows.doc_id) == set(texts)
    for d, part in rows.groupby("doc_id"):
        ids = np.array([*library(texts[d]), 2], "<u4")
        part = part.sort_values("start")
        assert part.start.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids) and (part.doc_tokens == len(ids)).all()
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in zip(part.start, part.length, part.ids_crc32, strict=True))
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() <= 4096


def test_word_features_alone_and_together():
    texts = ["One two two threefold", None, "", "one", "Zwölf-fünfzig"]
    row, bucket = toxicity.word_features(texts)
    for i, t in enumerate(texts):
        assert sorted(bucket[row == i]) == sorted(toxicity.word_features([t])[1])
    assert set(bucket[row == 3]) <= set(bucket[row == 0])


def test_pieces_fall_apart_at_white_space():
    coder = pieces.coder(PATH)
    coded = coder.code(pa.array(ODD))
    for i, t in enumerate(ODD):
        assert coded.of(i).tolist() == coder.code(pa.array([t], pa.string())).of(0).tolist()
