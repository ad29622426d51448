"""Cases in which a bound, a name or a missing id must not leave out a part of the work."""

import json
import random
import tracemalloc
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridledger.llm import bpe, fingerprints, language, pages, secrets, tokens, toxicity


# 8: toxicity

def test_every_expression_and_context_is_counted(spark):
    words = [f"word{i}" for i in range(300)]
    train = spark.createDataFrame([(0, " x ".join(words)), (1, " ".join(f"{w} common" for w in words))], "toxic int, text string")
    counts = toxicity._counts(train).filter("kind = 3").collect()
    assert len(counts) == 302
    assert sum(r.contexts == 300 for r in counts) == 1  # "common"
    assert {0, 2, 299, 300} == {r.contexts for r in counts}
    assert sum(r.ordinary + r.toxic == 1 for r in counts) == 2


def test_joined_ratios_give_the_same_scores(spark, monkeypatch):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        rows.append((i, " ".join(r.choices([f"word{n}" for n in range(200)], k=40) + toxic * ["grolk", "vrensh", f"plask{i % 8}"])))
        labels.append((i, toxic))
    rows += [(None, rows[0][1]), (0, rows[0][1]), (401, None), (402, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    result = lambda: sorted((str(r.doc_id), round(r.score, 9), round(r.log_ratio, 9)) for r in toxicity.toxicity(docs, labels).collect())
    whole = result()
    monkeypatch.setattr(toxicity, "HELD", 3)
    assert toxicity.fit(docs, labels).rest is not None
    assert result() == whole and len({s for _, s, _ in whole}) > 1


# 3: main text

def test_names_and_hidden_words_leave_article_text():
    kept = {
        "<article class='prose overflow-hidden'><p>one</p></article>": "one",
        "<article style='overflow:hidden' title='The hidden cost'><p>one <a href='/wiki/hidden-valley'>two</a></p></article>": "one two",
        "<div class='content-sidebar-wrap'><article><p>one</p></article></div>": "one",
        "<div class='sidebar'><article><p>one</p></article></div>": "one",
        "<div class='related'><p>old</p><article><p>old</p></article></div><article><p>one</p></article>": "one",
        "<article><h2 id='how-to-search'>one</h2><section id='privacy-notice'><p>two</p></section></article>": "one\ntwo",
        "<div>long text</div><article><p>teaser</p></article>": "long text\nteaser",
        "<article><p hidden>no</p><p style='color:red; display : none'>no</p><p aria-hidden=true>no</p><p>one</p></article>": "one",
        "<div class='cookie-notice'>no</div><p id='comments'>one<section id=comments>no</section>": "one",
    }
    assert {html: pages.main_text(f"<body>{html}</body>", set()) for html in kept} == kept


# 7: token counts

def test_memory_of_a_long_word_is_linear():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        counter = tokens.PrefixCounter(json.loads(file.read()))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    r = random.Random(5)
    words = ["".join(r.choices("etaoinshrdlu", k=8000)), "".join(r.choices("=-*#", k=5000)), "漢字" * 1500, "the" * 2000, "a" * 256, "b" * 257]
    tracemalloc.start()
    got = [counter.count(word) for word in words]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [len(library.encode(word, add_special_tokens=False).ids) for word in words]
    assert most < 20_000_000 and not any(len(word) > 256 for word in counter.words)


# pipeline

def test_rows_without_or_with_repeated_ids_are_deduplicated(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"w{i}" for i in range(200))
    texts = [(3, "same  text"), (None, "same text"), (5, "same text"), (5, "another text"), (None, "lone text"),
             (None, "lone text"), (7, long), (None, long + " end"), (8, "x " + long.upper()), (8, "of its own"), (9, "of its own")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in texts], schema)
    exact = corpus_pipeline.exact_dedup(spark, docs, "")
    rows = sorted((str(r.doc_id), r.text) for r in exact.collect())
    assert exact.columns == docs.columns
    assert rows == sorted((str(i), t) for i, t in [texts[0], *texts[3:5], *texts[6:10]])
    near = corpus_pipeline.near_dedup(spark, exact, "")
    rows = sorted((str(r.doc_id), r.text) for r in near.collect())
    assert near.columns == docs.columns
    assert rows == sorted((str(i), t) for i, t in [texts[0], *texts[3:5], texts[6], texts[9]])


# 1: secrets

def test_a_hundred_thousand_matches_take_seconds(spark):
    import hashlib
    import time

    text = "".join(f"token={'%06d' % i}; " for i in range(100_000))
    began = time.time()
    row = secrets.secret_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = ",".join(f"assign:{i * 14}:{i * 14 + 12}" for i in range(100_000))
    assert row.n_assign == 100_000 and row.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
    assert time.time() - began < 60


# 9: fingerprints

@pytest.mark.parametrize("condition", [
    "doc_id > 3", "n_chars > 10", "edited_sha256 > '8'", "fingerprint > '8'", "edited_fingerprint <> ''", "near_edited > 0.3",
    "near_next > 0.0", "n_shingles > 9", "inside_edited > 0.5"])
def test_a_filter_on_the_result_computes_nothing_twice(spark, condition):
    rows = [(i, " ".join(f"w{i * 7 + j * (i % 3)}" for j in range(80))) for i in range(12)]
    whole = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    some = whole.filter(condition)
    expected = spark.createDataFrame(whole.collect(), whole.schema).filter(condition)
    assert sorted(map(str, some.collect())) == sorted(map(str, expected.collect()))
    # Words are hashed once for the text and once for its edited form.
    assert some._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(lambda") <= 4


# 10: byte-level BPE

def test_a_run_of_a_million_letters_takes_seconds():
    import time

    import tiktoken

    codec = bpe.ByteCodec(bpe.read_ranks())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    r = random.Random(7)
    for word in ["".join(r.choices("etaoinshrdlu", k=1_000_000)), "ab" * 500, "漢字仮名" * 300, "=" * 129, "a" * 128, "=-" * 65]:
        began = time.time()
        assert np.frombuffer(codec.encode(word), "<u4").tolist() == library.encode_ordinary(word)
        assert time.time() - began < 60 and all(len(w) <= bpe.LONG for w in codec.words)


# pipeline

NAMES = ("_a", "_b", "_own", "_key", "_place", "_given", "kept", "count", "_new", "rejected", "a b.c", "component", "_times")


def test_stages_keep_given_columns_of_any_name(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [" ".join(f"wort{i * 13 + j}" for j in range(30)) for i in range(30)]
    rows = [(i, t, "de", f"s{i % 3}", i) for i, t in enumerate(words)] + [(40, words[0], "de", "s0", 1), (None, "x y", None, "s1", 2)]
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce("n_chars", F.lit(0))) for c in NAMES})
    given = {tuple(map(str, r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        found = {tuple(map(str, r)) for r in out.collect()}
        assert found <= given and found, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_give_no_rows_for_an_empty_table(spark, empty, name, stage):
    out = stage(spark, empty, "")
    assert out.count() == 0 and (name == "byte_bpe" or out.columns == empty.columns)


# 3: main text

def test_the_tree_finds_boilerplate_without_names(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choices("abcdefghij", k=6))
    sentence = lambda n: " ".join(word() for _ in range(n)) + "."
    rows, expected = [], {}
    for i in range(60):
        own = [sentence(12) for _ in range(3)]
        body = "".join(f"<section>{t}</section>" for t in own)
        rows.append((i, f"http://h{i % 3}.net/{i}", f"<body><div><ul><li>Home</li><li>About us</li></ul></div><main><div>{body}</div></main>"
                     f"<div><span>All rights kept by h{i % 3}.</span></div></body>"))
        expected[i] = "\n".join(own)
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages.extracted(table).collect()} == expected
    assert {r.page_id for r in pages.extracted(table, threshold=-1.0).collect() if r.text != expected[r.page_id]} == set(expected)


def plain_importance(parsed):
    """Importance of the nodes of one site by its definition, page by page."""
    from math import log

    shown, content, seen = {}, {}, {}
    for n, (blocks, nodes) in enumerate(parsed):
        for node, style in nodes:
            shown.setdefault(node, Counter())[style] += 1
        for block in blocks:
            for part in pages._SENTENCE.split(block.text):
                if part:
                    content.setdefault(block.id, {}).setdefault(part, Counter())[n] += 1
        for node in {x for x, _ in nodes} | {b.id for b in blocks}:
            seen.setdefault(node, set()).add(n)
    entropy = lambda counts, base: -sum(c / sum(counts) * log(c / sum(counts), base) for c in counts)
    found = {}
    for node, on in seen.items():
        if len(on) == 1:
            found[node] = 1.0
            continue
        styles = shown.get(node, Counter())
        weight = pages.GAMMA ** max(len(styles) - 1, 0)
        mean = [entropy(c.values(), len(on)) for c in content.get(node, {}).values()]
        found[node] = (1 - weight) * min(1.0, entropy(styles.values(), len(on)) if styles else 0.0) + weight * (1 - (sum(mean) / len(mean) if mean else 0.0))
    return found


def test_importance_equals_a_plain_one(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("url", "html").collect()
    host = max(Counter(r.url.split("/")[2] for r in rows).items(), key=lambda x: x[1])[0]
    own = [r.html for r in rows if r.url.split("/")[2] == host]
    expected = plain_importance([pages.parse(h) for h in own])
    counts = spark.createDataFrame([("h", h) for h in own], "host string, html string").mapInArrow(
        pages._statistics, "host string, node long, kind int, feature long, n long, nlogn double")
    got = {r.node: r.importance for r in pages._importance(counts, ["host", "node"]).collect()}
    assert got.keys() == expected.keys() and all(abs(got[n] - expected[n]) < 1e-9 for n in got)


def test_odd_repeated_and_deep_pages(spark):
    import time

    deep = "<div>" * 20_000 + "deep" + "</x>" * 20_000
    rows = [(1, None, None), (2, "", ""), (3, "odd url", "plain text"), (3, "odd url", "plain text"), (None, "http://a.b", "<p>x &amp; y"),
            (4, "http://a.b/c", deep), (5, "http://a.b/d", '<p title="' * 50_000 + "end"), (6, "http://a.b/e", "<a " * 100_000), (7, "u", "<!-- open")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit(c) for c in ("host", "weak", "pages", "node", "text", "n_chars")})
    began = time.time()
    got = sorted(((str(r.page_id), r.text) for r in pages.extracted(table).collect()))
    assert time.time() - began < 60
    texts = dict(got)
    assert len(got) == len(rows) and [t for i, t in got if i == "3"] == ["plain text"] * 2
    assert texts["1"] == texts["2"] == texts["7"] == "" and texts["None"] == "x & y" and texts["4"] == "deep"
    assert pages.extracted(table.limit(0)).count() == 0


# 4: language

def test_weights_and_cosines_equal_a_plain_recomputation(spark):
    import math
    import zlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, model = docs.collect(), language.fit(docs)
    train = [r for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5]
    features = {r.doc_id: Counter(language._features(r.text).tolist()) for r in rows}
    frequency = Counter(f for r in train for f in features[r.doc_id])
    weight = [math.log((1 + len(train)) / (1 + frequency[f])) + 1 for f in range(language.FEATURES)]
    assert np.allclose(model.idf, weight, atol=1e-4)
    assert np.allclose(np.linalg.norm(model.centroids, axis=1), 1, atol=1e-4) and len(model.centroids) == 4 * len(model.languages)
    got = {r.doc_id: r for r in language.languages(docs, model).collect()}
    for r in rows:
        vector = {f: math.log1p(n) * weight[f] for f, n in features[r.doc_id].items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        cosines = [sum(x * c[f] for f, x in vector.items()) / norm for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert abs(got[r.doc_id].score - cosines[best]) < 1e-4
        assert got[r.doc_id].lang_pred == model.languages[model.owner[best]]


# 8: toxicity

def plain_ratios(texts):
    """Mean log ratio of each word by the definition: documents of each class, different words before, shared backoff."""
    from math import log, sqrt

    words = [(toxic, text.lower().split()) for toxic, text in texts]
    documents = [sum(t == c for t, _ in words) for c in (0, 1)]
    kinds = []
    for head in toxicity.HEADS:
        counts, before = (Counter(), Counter()), {}
        for toxic, line in words:
            counts[toxic].update({w[:head] for w in line})
            for previous, w in zip(line, line[1:]):
                before.setdefault(w[:head], set()).add(previous)
        every = set(counts[0]) | set(counts[1])
        contexts = {e: len(before.get(e, ())) + 1 for e in every}
        discount = toxicity.DISCOUNT
        taken = sum(min(c[e], discount) for c in counts for e in every) / sum(documents)
        ratio = {}
        for e in every:
            logs = [log(max(c[e] - discount, 0) / n + taken * contexts[e] / sum(contexts.values())) for c, n in zip(counts, documents)]
            chance = toxicity.ERRORS * sqrt(1 / (counts[0][e] + 0.5) + 1 / (counts[1][e] + 0.5))
            size = max(abs(logs[1] - logs[0]) - chance, 0)
            ratio[e] = size if logs[1] > logs[0] else -size
        kinds.append(ratio)
    return {w: sum(k[w[:h]] for k, h in zip(kinds, toxicity.HEADS)) / len(kinds) for _, line in words for w in line}


def test_log_ratios_equal_plain_ones(spark):
    import pyarrow as pa

    r = random.Random(4)
    vocabulary = ["".join(r.choices("abcdef", k=r.randint(1, 12))) for _ in range(150)]
    texts = []
    for i in range(300):
        line = r.choices(vocabulary, k=20)
        texts.append((i % 3 == 0, " ".join(line + (r.choices(["grolkish", "grolk", "vren", "vrensher"], k=4) if i % 3 == 0 else []))))
    expected = plain_ratios([(int(t), x) for t, x in texts])
    train = spark.createDataFrame([(int(t), x) for t, x in texts], "toxic int, text string")
    classes = dict(train.groupBy("toxic").count().collect())
    rows = toxicity._ratios(toxicity._counts(train), (classes[0], classes[1])).collect()
    hashes = np.array([x.word for x in rows], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    model = toxicity.Model(hashes[order], np.array([x.ratio for x in rows])[order], np.zeros(4))
    words = sorted(expected)
    got = np.concatenate([model.ratio(w) for _, w, _ in toxicity._expressions(pa.array([" ".join(words)]))])
    assert np.allclose(got, [expected[w] for w in words], atol=1e-9) and (np.abs(got) > 0.5).sum() >= 2
