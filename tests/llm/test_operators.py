"""Each operator on small tables: odd rows, empty tables, and a plain version of the same result."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import LONG, ROWS, words
from pyspark.sql import functions as F

from gridledger.llm import (
    bpe, dedup, fingerprints, language, mixing, neardup, pages, secrets, tokens, toxicity,
)

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LABELS = "doc_id long, toxic int"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def by_id(df):
    return {r["doc_id"]: r for r in rows_of(df) if r["doc_id"] is not None}


def operators(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, None), (None, 1), (8, 1), (8, 0)], LABELS)
    return {
        1: secrets.secret_scan, 2: neardup.near_components, 4: language.languages, 5: dedup.exact_groups, 6: mixing.mixed,
        7: tokens.token_counts, 8: lambda d: toxicity.toxicity(d, labels), 9: fingerprints.fingerprints, 10: bpe.encoded,
    }


@pytest.mark.parametrize("number", [1, 2, 4, 5, 6, 7, 8, 9, 10])
def test_every_row_gives_a_row_and_an_empty_table_none(spark, odd, empty, number):
    operator = operators(spark)[number]
    assert sorted(str(r["doc_id"]) for r in rows_of(operator(odd))) == sorted(str(r[0]) for r in ROWS)
    none = operator(empty)
    assert none.columns == operator(odd).columns and none.count() == 0


# 1: secrets

def plain_spans(text):
    out = []
    for m in re.finditer(secrets.ASSIGN.replace("(?i)", "(?i:") + ")", text, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def plain_hot(text):
    """Windows counted anew at each place."""
    out = []
    for m in re.finditer(r"[0-9A-Za-z+/_-]{20,}", text):
        value = m[0]
        if not (re.search("[0-9]", value) and re.search("[A-Za-z]", value)) or any(re.search(p, value) for p in secrets.ALLOWED):
            continue
        for order, (kind, consists, _, bits) in enumerate(secrets.CLASSES, 3):
            if not re.search(consists, value):
                continue
            runs = []
            for i in range(len(value) - secrets.WINDOW + 1):
                n = np.array(list(Counter(value[i:i + secrets.WINDOW]).values())) / secrets.WINDOW
                if round(float(-(n * np.log2(n)).sum()), 9) >= bits:
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = i + secrets.WINDOW
                    else:
                        runs.append([i, i + secrets.WINDOW])
            out += [(m.start() + a, order, m.start() + b, kind) for a, b in runs]
    return out


def test_secret_spans_equal_a_plain_scan(spark):
    r = random.Random(3)
    key = lambda n, letters="ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/": "".join(r.choice(letters) for _ in range(n))
    texts = [
        "password=abc password=token:abcdef Token : 'a.b-c=d' api-key=1234567 apikey=123456 api_key=x123456",
        "é😀 secret\"= \"s3cr3t!\" PASSWD:12345 sEcReT=======", "AKIA" + "A1" * 8 + " AKIA123 xAKIA" + "Z" * 30 + "a",
        "0123456789abcdef01234567 0123456789abcdef0123456 " + "a" * 40, "A" * 25 + "1", key(64) + " " + key(19) + " " + key(40, "0123456789ABCDEF"),
        "aaaaaaaaaaaaaaaaaaaa1" + key(40) + "aaaaaaaaaaaaaaaaaaaaaaaaaaaa" + key(30), "example" + key(40), "token=" + key(40),
        "123e4567-e89b-12d3-a456-426614174000", "", None, *[key(r.randint(20, 90)) for _ in range(20)],
    ]
    got = by_id(secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    for i, text in enumerate(texts):
        base = plain_spans(text or "")
        added = [s for s in plain_hot(text or "") if not any(b[0] <= s[0] and b[2] >= s[2] for b in base)]
        assert [tuple(s) for s in got[i]["base"]] == base, text
        assert [tuple(s) for s in got[i]["added"]] == sorted(added), text


# 2: near duplicates

def plain_sets(text):
    w = [w for w in re.split(SPACE, (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_components(rows):
    sets = {i: plain_sets(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_components_equal_all_pairs(spark):
    r = random.Random(5)
    vocabulary = [f"v{i}" for i in range(3000)]
    passage = r.choices(vocabulary, k=60)
    rows = []
    for i in range(160):
        kind = i % 5
        if kind == 0 or i < 10:
            w = r.choices(vocabulary, k=r.randint(1, 120))
        elif kind == 1:  # an edited copy
            w = rows[r.randrange(len(rows))][1].split()
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
        elif kind == 2:  # a chain: the end moves on
            w = rows[-1][1].split()[2:] + r.choices(vocabulary, k=2)
        elif kind == 3:  # a shared passage
            w = passage + r.choices(vocabulary, k=r.randint(0, 60))
        else:  # upper case and other spaces
            w = rows[r.randrange(len(rows))][1].upper().split()
        rows.append((i, "  ".join(w) if kind == 4 else " ".join(w)))
    r.shuffle(rows)
    want = plain_components(rows)
    got = by_id(neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (g["n_shingles"], g["component_id"]) for i, g in got.items()} == want
    assert all(g["kept"] == (g["component_id"] == i) for i, g in got.items())


@pytest.mark.parametrize("small", [64, 0])
def test_planted_pairs_just_above_the_threshold_are_found(spark, monkeypatch, small):
    """Every pair of a similarity of 0.75 to 0.80, of texts of many lengths, by pairs or by blocks alone."""
    monkeypatch.setattr(neardup, "SMALL", small)
    r = random.Random(12)
    rows, expected = [], 0
    for i in range(500):
        words_ = [f"p{i}x{j}" for j in range(r.randint(60, 400))]
        edited, at = list(words_), len(words_) // 2
        while True:
            a, b = neardup._shingles(" ".join(words_)), neardup._shingles(" ".join(edited[:at] + ["new"] + edited[at + 1:]))
            if len(a & b) / len(a | b) < 0.75:
                break
            edited, at = edited[:at] + ["new"] + edited[at + 1:], r.randrange(len(words_))
        b = neardup._shingles(" ".join(edited))
        expected += 0.75 <= len(a & b) / len(a | b) <= 0.80
        rows += [(2 * i, " ".join(words_)), (2 * i + 1, " ".join(edited))]
    got = by_id(neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert expected > 400 and all(got[2 * i + 1]["component_id"] == 2 * i for i in range(500))


def test_sets_that_are_equal_in_another_order_are_confirmed(spark, monkeypatch):
    texts = ["a b c d e a b c d e a", "b c d e a b c d e a b", "a b c d e a b c d e a b c d e a", "x " * 9, "x " * 12, "q r s t u"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {i: (g["n_shingles"], g["component_id"]) for i, g in by_id(neardup.near_components(docs)).items()}
    assert got == {i: c for i, c in plain_components(list(enumerate(texts))).items()}
    # As if hashes had collided: what is not confirmed has a set of its own.
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, _: pairs.limit(0))
    rows = neardup._equal_sets(neardup.described(docs), docs).select("doc_id", "_set").collect()
    assert len({r["_set"] for r in rows}) == 6


def test_large_group_and_sharers_of_a_passage(spark):
    r = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        if i % 2:
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(150)] = f"x{r.random()}"
        else:
            w = base[:60] + [f"y{r.random()}" for _ in range(80)]
        rows.append((i, " ".join(w)))
    got = by_id(neardup.near_components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {i: (g["n_shingles"], g["component_id"]) for i, g in got.items()} == plain_components(rows)


def test_near_components_of_odd_rows(odd):
    got = by_id(neardup.near_components(odd))
    named = [(i, t) for i, t, *_ in ROWS if i is not None]
    want = plain_components(list(dict(named).items()))
    assert {i: (g["n_shingles"], g["component_id"]) for i, g in got.items()} == want


def test_signature_keys_meet_within_one_symbol(spark):
    a, b = 0x0001000200030004, 0x0001000200039994
    keys = spark.createDataFrame([(a, b)], "a long, b long").select(
        F.array(*neardup.chunk_keys(F.col("a"), 2)).alias("a"), F.array(*neardup.chunk_keys(F.col("b"), 2)).alias("b")).first()
    assert len(set(keys.a) & set(keys.b)) == 1


# 3: pages

def test_main_text_of_marked_pages(spark):
    html = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body class=has-sidebar><header><h1>Site</h1></header>"
        "<nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; line</h1>"
        "<p>One <b>two<br>three<p>Fo&#117;r&nbsp;&eacute; <i>five</i></article><section id=comments><p>nice</p></section>"
        "<form><p>mail</p></form><aside>more</aside><footer>&copy; us</footer></body></html>")
    rows = [(1, "http://a.example/1", html), (2, None, None), (3, "odd", ""), (4, "http://a.example/2", "plain < text"),
            (None, "http://a.example/3", "<p>a<p>b")]
    got = {r["page_id"]: r for r in rows_of(pages.extracted(
        spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("weak", F.lit(2))))}
    assert got[1]["text"] == "Head & line\nOne two three\nFour é five" and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[None]["text"]) == ("", "", "plain < text", "a\nb")


def test_style_tree_finds_repeated_branches_without_names(spark):
    r = random.Random(2)
    sentence = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(12)) + "."
    slogans = [f"Buy now {i}" for i in range(3)]
    rows, want = [], {}
    for i in range(60):
        text = [sentence() for _ in range(4)]
        html = (f"<body><div><div><div>Home</div><div>About us</div></div></div><section>{''.join(f'<div>{t}</div>' for t in text)}"
                f"</section><div><table><tr><td>{r.choice(slogans)}</table></div></body>")
        rows.append((i, "http://www.plain.example/x", html))
        want[i] = "\n".join(text)
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in rows_of(got)} == want


def test_an_article_that_all_pages_of_a_site_repeat_stays(spark):
    html = "<body><nav>menu</nav><article><p>The same words on every page.</p></article></body>"
    rows = [(i, "http://same.example/", html) for i in range(50)]
    got = pages.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["text"] for r in rows_of(got)} == {"The same words on every page."}
    assert pages.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 4: language

def test_languages_of_held_out_documents(spark):
    r = random.Random(4)
    syllables = {"xa": ["ka", "lo", "mi", "tu"], "yb": ["ger", "sch", "und", "ein"], "zc": ["que", "oi", "eau", "ier"]}
    rows = []
    for i in range(300):
        lang = r.choice(list(syllables))
        rows.append((i, " ".join("".join(r.choices(syllables[lang], k=r.randint(1, 4))) for _ in range(r.randint(3, 60))),
                     None if i % 11 == 0 else lang, lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, true string")
    got = by_id(language.languages(docs))
    assert all(got[i]["lang_pred"] == true for i, _, _, true in rows)
    assert all(0 <= g["score"] <= 1 and not g["rejected"] for g in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    strange = spark.createDataFrame(
        [(1, "123 ...", None), (2, None, None), (3, "漢字 " * 200, None), (4, "kalomi tuka " * 20, None)], "doc_id long, text string, lang string")
    found = by_id(language.languages(strange, language.fit(docs)))
    assert [found[i]["lang_pred"] for i in (1, 2)] == ["und", "und"]
    assert [found[i]["rejected"] for i in (1, 2, 3, 4)] == [True, True, True, False]
    assert language.without_rejected(strange, language.fit(docs)).select("doc_id").collect() == [(4,)]


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, "kalo mitu " * 5, "aa" if zlib.crc32(str(i).encode()) % 5 else "held") for i in range(60)]
    got = language.languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in rows_of(got)} == {"aa"}


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "One two,  three! é ß Ünd 42 four" * 9
    whole = sorted(language._features(text))
    for piece in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert sorted(language._features(text)) == whole


@pytest.mark.parametrize("unknown", ["de", "es", "fr"])
def test_texts_of_an_unlearned_language_are_rejected(spark, unknown):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) >= 64")
    known = docs.withColumn("lang", F.when(F.col("lang") != unknown, F.col("lang")))
    found = language.languages(known).join(docs.select("doc_id", "lang"), "doc_id")
    shares = {r.foreign: r.share for r in found.groupBy((F.col("lang") == unknown).alias("foreign")).agg(
        F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    assert shares[True] > 0.9 and shares[False] < 0.01


# 5: exact dedup

def test_exact_groups_of_odd_rows(odd):
    normal = lambda t: SPACE.sub(" ", t or "")
    size = Counter(normal(t) for _, t, *_ in ROWS)
    first = {}
    for i, t, *_ in ROWS:
        if i is not None:
            first[normal(t)] = min(i, first.get(normal(t), i))
    for got in rows_of(dedup.exact_groups(odd).join(odd.select("doc_id", "text").distinct(), "doc_id")):
        t = normal(got["text"])
        assert (got["keep_id"], got["group_size"], got["kept"]) == (first[t], size[t], got["doc_id"] == first[t])
        assert got["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_texts_with_one_digest_are_told_apart(spark):
    rows = [(i, f"text {i % 7}") for i in range(60)] + [(100, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = dedup.exact_groups(docs, digest=lambda text: F.length(text).cast("string"))
    assert sorted(weak.collect()) == sorted(dedup.exact_groups(docs).collect())


# 6: mixing

def plain_targets(sizes, epochs=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: epochs * sizes[s] for s in over}
        open_ -= over
    return target


def test_mix_meets_targets(spark):
    r = random.Random(6)
    sources = ["b", "a", "Z", "é", None, "tiny", "", "zero"]
    rows = [(i, "w " * (0 if i % 8 == 7 else r.randint(1, 3) if i % 8 == 5 else r.randint(0, 60)), sources[i % 8]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = plain_targets(sizes)
    taken, got = Counter(), by_id(mixing.mixed(docs))
    for i, t, s in rows:
        assert got[i]["size"] == len(t.split()) and got[i]["source_size"] == sizes[s]
        assert got[i]["target"] == pytest.approx(want[s]) and 0 <= got[i]["taken"] <= 3 * got[i]["size"]
        taken[s] += got[i]["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert got == by_id(mixing.mixed(docs.repartition(7)))


def test_small_buckets_give_the_same_mix(spark, monkeypatch):
    rows = [(i, "w " * (i % 13), f"s{i % 3}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    before = by_id(mixing.mixed(docs))
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 5)
    assert by_id(mixing.mixed(docs)) == before


def test_repeated_rows_follow_the_mix(spark):
    rows = [(i, "w " * 10, "ab"[i % 10 > 0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter(r["doc_id"] for r in rows_of(mixing.repeated(docs)))
    for r in rows_of(mixing.mixed(docs)):
        assert abs(times[r["doc_id"]] * 10 - r["taken"]) <= 5
    assert mixing.repeated(docs).columns == docs.columns


# 7: token counts

ODD_TEXTS = [
    "", " ", "Don't we'll I'VE 12½ ²x y z", "ΣΑΣ ΑΣ\tİ é ñ <|endoftext|> a<|startoftext|><|endoftext|>b <|endoftext", "😀😀 a😀b 𝔘𝔫𝔦 漢字かな",
    "\x1c\x1d a\x85b \r\n\r\n  x   ", "x" * 3000, "...!!!??? -- ''s 't", "​﻿ zero", "à́ Å Å ﬁ ǅ ß ẞ", LONG,
]


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = by_id(tokens.token_counts(spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string")))
    for i, t in enumerate(ODD_TEXTS):
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (count(t), len(t.encode()), count(t) > 2048)


def test_prefixes_answer_budgets(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = ["Some antidisestablishmentarian words, and numbers 123.", "<|endoftext|>x y", "", "é à ü unbelievable"]
    stored = tokens.token_prefixes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for row in stored.collect():
        assert all(count(row.text[:e]) == n for e, n in zip(row.ends, row.counts))
    for budget in (0, 1, 3, 8, 100):
        for row in tokens.fit(stored, budget).collect():
            fitting = [e for e, n in zip(row.ends, row.counts) if n <= budget]
            assert row.text_fit == row.text[:max(fitting, default=0)] and row.n_fit == count(row.text_fit) <= budget
    assert {r.doc_id: r.n_before for r in tokens.tokens_before(stored, 5).collect()}[0] == count("some")
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        counter = tokens.counter_of(file.read())
    assert counter.inside("unbelievable") == [count("unbelievable"[:i]) for i in range(1, 13)]


# 8: toxicity

def test_toxicity_of_held_out_documents(spark):
    r = random.Random(7)
    clean, bad = [f"word{i}" for i in range(400)], ["grolk", "vrensh", "plask"]
    rows, labels = [], []
    for i in range(900):
        toxic = int(r.random() < 0.2)
        w = r.choices(clean, k=r.randint(30, 120))
        for _ in range(toxic * max(2, len(w) // 30)):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    got = by_id(toxicity.toxicity(docs, spark.createDataFrame(labels, LABELS)))
    held = [i for i in range(900) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i][1] for i in held) >= 0.99 * len(held)
    assert got[1000]["score"] == got[1001]["score"] < 0.5
    # Labels of held-out rows change nothing.
    turned = [(i, 1 - t if got[i]["held_out"] else t) for i, t in labels]
    again = by_id(toxicity.toxicity(docs, spark.createDataFrame(turned, LABELS)))
    assert {i: g["score"] for i, g in again.items()} == {i: g["score"] for i, g in got.items()}


def test_counts_of_expressions(spark):
    train = spark.createDataFrame([(1, "ab ab cd"), (0, "ab, CD"), (0, "")], "toxic int, text string")
    counted = train.coalesce(1).mapInArrow(
        toxicity._counted, "word long, kind long, ordinary long, toxic long, mask long").filter("kind = 3")
    found = sorted(tuple(r) for r in counted.groupBy("word").agg(F.sum("ordinary"), F.sum("toxic")).select(
        "sum(ordinary)", "sum(toxic)").collect())
    assert found == [(1, 1), (1, 1)]
    n = np.array([0.0, 50.0, 1.0])
    ratio = toxicity.log_ratios(n, n[::-1].copy() * 0 + np.array([40.0, 5.0, 1.0]), np.array([9.0, 9.0, 1.0]), (100, 50))
    assert ratio[0] > 0 and ratio[2] == 0


# 9: fingerprints

def test_sketches_equal_plain_ones(spark):
    import xxhash

    chain = lambda values: __import__("functools").reduce(
        lambda seed, v: xxhash.xxh64(v if isinstance(v, bytes) else int(v).to_bytes(8, "little", signed=True), seed).intdigest(), values, 42)
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def plain(text):
        w = [signed(chain([w.encode()])) for w in SPACE.split(text.strip(" \t\n\x0b\f\r")) if w]
        runs = [w[i:i + 5] for i in range(max(1, len(w) - 4))] if w else []
        return sorted({signed(chain(run)) for run in runs})[:fingerprints.K]

    texts = {i: t or "" for i, t, *_ in ROWS if i not in (None, 12)}
    got = by_id(fingerprints.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    order = sorted(texts, reverse=True)
    shown = lambda s: "".join(f"{h % (1 << 64):016x}" for h in s)

    def like(a, b):
        both = sorted({*a, *b})[:fingerprints.K]
        return len({*both} & {*a} & {*b}) / len(both) if both else 1.0

    for i, following in zip(order, order[1:] + order[:1]):
        t, n, half = texts[i], texts[following], len(texts[i]) // 2
        edited = t[:len(t) - half] + n[:half]
        own = got[i]
        assert own["n_chars"] == len(t) and own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (own["fingerprint"], own["edited_fingerprint"]) == (shown(plain(t)), shown(plain(edited)))
        assert own["near_edited"] == pytest.approx(like(plain(t), plain(edited)))
        assert own["near_next"] == pytest.approx(like(plain(t), plain(n)))


def test_next_rows_over_many_buckets(spark):
    r = random.Random(9)
    ids = r.sample(range(100_000), 300) + [7_000_000]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, v string").repartition(5)
    got = {x.doc_id: x.next_v for x in fingerprints.with_next(docs, ["v"], per_bucket=3).collect()}
    order = sorted(ids, reverse=True)
    assert got == {i: f"t{j}" for i, j in zip(order, order[1:] + order[:1])}


def test_sketches_merge_and_estimate(spark):
    a, b = words(3000), words(3000, 1500)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a + " " + b)], "doc_id long, text string")
    sketched = fingerprints.add_sketch(fingerprints.add_shingles(rows, "text", "s"), "s", "sketch")
    parts = {r.doc_id: r.sketch for r in fingerprints.merge_sketches(sketched, ["doc_id"], "sketch").collect()}
    assert len(set(parts[1]) & set(parts[2])) >= fingerprints.K - 4
    both = sketched.filter("doc_id = 1").orderBy("text").collect()
    pair = spark.createDataFrame([(both[0].sketch, both[1].sketch)], "a array<long>, b array<long>").select(
        fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"),
        fingerprints.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(pair.r - 1 / 3) < 0.2 and abs(pair.c - 0.5) < 0.25 and 2000 < pair.n < 4500


# 10: byte-level BPE

def test_ids_equal_the_library_and_come_back(spark):
    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(), special_tokens={})
    got = by_id(bpe.encoded(spark.createDataFrame(list(enumerate(ODD_TEXTS)), "doc_id long, text string"), with_ids=True))
    for i, t in enumerate(ODD_TEXTS):
        want = library.encode_ordinary(t)
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_fold_by_functions_equals_the_fold(spark):
    ranks = bpe.read_ranks()
    codec = bpe.ByteCodec(ranks)
    given = [b" the", b"x", b"antidisestablishment", "é漢".encode(), b"aaaaaaa", bytes(range(200, 220)), b" qzxj"]
    got = bpe.fold_by_functions(spark.createDataFrame([(w,) for w in given], "word binary"), ranks).collect()
    assert {bytes(r.word): r.ids for r in got} == {w: codec.fold(w) for w in given}
