"""Operators 11 to 13 against plain versions, on odd rows and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from odd_rows import LONG, ROWS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridledger.llm import divergence, manifest, ordering, packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def given(spark, rows, clash=()):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in clash})


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# places in sorted groups

def test_places_of_a_group_that_lies_in_many_partitions(spark):
    r = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 50}", r.randrange(500)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordering.numbered(df, "g", [F.col("v").desc()], "at", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = Counter(g for g, _ in rows)
    assert all(x.n == sizes[x.g] for x in got)
    for g in sizes:
        ordered = sorted((x.at, x.v) for x in got if x.g == g)
        assert [a for a, _ in ordered] == list(range(sizes[g]))
        assert [v for _, v in ordered] == sorted((v for h, v in rows if h == g), reverse=True)


# 11: Merkle manifest

def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, place in zip(paths, range(len(at))):
            start = at[place] // fanout * fanout
            run, own = nodes[start:start + fanout], at[place] - start
            path.append(("".join(run[:own]), "".join(run[own + 1:])))
            at[place] //= fanout
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def plain_manifest(rows, fanout=16):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    trees = []
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        group = sorted(groups[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
        trees.append((group, *plain_tree([plain_leaf(r, r["text"]) for r in group], fanout)))
    root, tops = plain_tree([t[1] for t in trees], fanout)
    out = []
    for (group, subroot, paths), top in zip(trees, tops):
        for row, path in zip(group, paths):
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = plain_leaf(row, text)
            for before, after in path + top:
                node = digest(before, node, after)
            proof = digest(*[side for step in path + top for side in step])
            out.append((row["doc_id"], plain_leaf(row, row["text"]), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


SHAPES = {
    "one": [(1, "A", "b", None, 1)],
    "two sources": [(1, "A", "b", None, 1), (2, "A", "b", "", 1)],
    "one source": [(i, "Abc", "x", "s", 3) for i in range(40)],
    "null ids and many sources": [(None,) * 5] * 3 + [(5, "x", None, "é", None)] * 20 + [(i, "T", "e", f"s{i}", None) for i in range(300)],
    "last run of one": [(i, f"T{i}", "e", "a" if i < 257 else "b", i) for i in range(290)],
    "odd rows": ROWS,
}


@pytest.mark.parametrize("shape", SHAPES)
def test_manifest_equals_a_plain_one(spark, shape):
    df = given(spark, SHAPES[shape], ("tree", "pos", "leaf", "path", "_seq", "run"))
    assert result(manifest.merkle_manifest(df)) == plain_manifest([r.asDict() for r in df.collect()])


def test_manifest_of_deep_trees_and_its_paths(spark):
    df = given(spark, [(i, f"Text {i}", "e", "hot" if i % 3 else f"s{i % 10}", i) for i in range(400)])
    assert result(manifest.merkle_manifest(df, 2)) == plain_manifest([r.asDict() for r in df.collect()], 2)
    paths = manifest.proofs(df, 2).select("leaf", "root", manifest.folded(F.col("leaf"), F.col("path")).alias("found"))
    assert paths.filter("root = found").count() == 400


def test_manifest_finds_each_change(spark):
    df = given(spark, [(i, f"text {i}" if i % 2 else f"Text {i}", "e", f"s{i % 3}", i) for i in range(200)])
    got = {r.doc_id: r for r in manifest.merkle_manifest(df).filter("verified OR NOT verified").collect()}
    touched = {i for i in range(0, 200, 2) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert touched and {i for i, r in got.items() if not r.verified} == touched


# 12: source divergence

def plain_divergence(rows, least=10, top=10):
    groups, counts, documents = set(), Counter(), Counter()
    for _, text, lang, source, _ in rows:
        group = (lang or "", source or "")
        groups.add(group)
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts.update((*group, t) for t in terms)
        documents.update((group[0], t) for t in set(terms))
    kept = {}
    for lang, term in documents:
        if documents[lang, term] >= least:
            kept.setdefault(lang, []).append(term)
    out = []
    for lang, source in groups:
        terms = kept.get(lang, [])
        sources = [s for l, s in groups if l == lang]
        own = {s: {t: counts[lang, s, t] for t in terms} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in terms}
        share = lambda table, t: 1 + 10 ** 9 * (table[t] + 2) // (sum(table.values()) + 2 * len(terms))
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        pairs = [(-sum(gap(share(own[source], t), share(own[s], t)) for t in terms), s) for s in sources if s != source]
        typical = [(-gap(share(own[source], t), share(whole, t)), t) for t in terms
                   if own[source][t] and share(own[source], t) > share(whole, t)]
        for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))),
                            ("term", sorted(typical, key=lambda x: (x[0], x[1].encode()))[:top])):
            out += [(lang, source, part, item, -value, rank) for rank, (value, item) in enumerate(found, 1)]
    return sorted(out, key=str)


def texts(n, seed=2):
    r = random.Random(seed)
    words = ["The", "of", "É", "ß", "naïve", "漢字", "x1y", "don't"] + [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    return [(i, " ".join(r.choices(words[: 20 + 12 * (i % 16)], k=r.randrange(1, 80))), r.choice(["en", "en", "de", None]),
             r.choice([None, "", "a", "b", "c", "é", "z"]), 0) for i in range(n)]


def test_divergence_equals_a_plain_one(spark):
    rows = texts(400) + [(None, None, "lone", "a", 0), (None, "of", "few", "a", 0), (1, "the", "few", "b", 0), (2, None, "few", None, 0)] + list(ROWS)
    df = given(spark, rows, ("term", "n", "docs", "id", "total", "place"))
    whole = result(divergence.divergence(df))
    assert whole == plain_divergence(rows) and {r[2] for r in whole} == {"pair", "term"}
    assert [r[4] for r in whole if r[0] == "few" and r[2] == "pair"] == [0] * 6
    # Trees over several segments and sources in several blocks; counts that workers pass on early.
    assert result(divergence.divergence(df, segment=16, block=2)) == whole
    assert result(divergence.term_counts(df, 20)) == result(divergence.term_counts(df))


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = " ".join(f"Word{chr(97 + i % 20)} é" for i in range(500)).encode()
    tables = []
    for piece in (1 << 20, 7):
        monkeypatch.setattr(divergence, "PIECE", piece)
        counts = divergence._Counts()
        counts.add(("en", "a"), text)
        tables.append(counts.groups[("en", "a")])
        assert counts.held == 22  # the group itself counts as one
    assert tables[0] == tables[1] and tables[0][1]["é".encode()] == 1


def test_equal_subtrees_are_one_node():
    counts = np.zeros((3, 64), np.int64)
    counts[2, 5] = 7
    levels, values, roots = divergence.hash_consed(counts)
    assert roots[0] == roots[1] != roots[2] and list(values) == [0, 7]
    assert [len(left) for left, _ in levels] == [2] * 6
    sums = divergence.compared(np.array([0, 0]), np.array([1, 2]), (levels, values, roots), np.array([0, 0, 7]), 64)
    p, q, own = 1 + 2 * 10 ** 9 // 128, 1 + 2 * 10 ** 9 // 135, 1 + 9 * 10 ** 9 // 135
    assert list(sums) == [0, 63 * ((p - q) ** 2 // (p + q)) + (p - own) ** 2 // (p + own)]


def test_shares_are_exact_beyond_53_bits():
    n = np.array([0, 1, 9_300_000_000, 8 * 10 ** 15], np.int64)
    total = np.array([10 ** 15, 3, 9 * 10 ** 15, 8 * 10 ** 15], np.int64)
    terms = np.full(4, 12345, np.int64)
    assert [int(x) for x in divergence.shares(n, total, terms)] == [
        1 + 10 ** 9 * (int(a) + 2) // (int(b) + 2 * 12345) for a, b in zip(n, total)]


# 13: packing

def check_packing(df, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    documents = {}
    for row in rows:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids + [0]
        documents.setdefault(row[0], []).append(np.array(ids, "<u4"))
    got = df.collect()
    by_id, by_sequence = {}, {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_id.keys() == documents.keys()
    for doc_id, ids in documents.items():
        expected = Counter()
        for one in ids:
            expected.update((at, n, zlib.crc32(one[at:at + n].tobytes()), len(one)) for at, n in packing.cuts(len(one)))
            assert np.concatenate([np.arange(at, at + n) for at, n in packing.cuts(len(one))]).tolist() == list(range(len(one)))
        assert Counter((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in by_id[doc_id]) == expected
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return len(by_sequence), sum(r.length for r in got)


def test_packing_of_odd_rows(spark, odd):
    rows = [*ROWS, (2 ** 60 + 1, "far id", "en", "a", 1), (20, "before <|endoftext|> after", "en", "a", 1), (21, "x " * 1023, "en", "a", 1)]
    check_packing(packing.sequences(given(spark, rows, ("piece", "bin", "length", "start", "sequence_id"))), rows)


def test_packing_pads_little(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    windows, tokens = check_packing(packing.sequences(rows), [tuple(r) for r in rows.collect()])
    assert tokens / (windows * packing.WINDOW) > 0.99


def test_very_long_runs_are_encoded_in_seconds():
    codec, library = packing.Tokenizer(packing.read_ranks()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(6)
    long = "".join(r.choices("etaoin shrdlu é漢 \n12.,'s", k=250_000))
    for text in ("ab" * 100_001, " " * 300_000, "\n" * 250_000 + "x", "=" * 100_000, LONG, long, long[:1000] + "<|endoftext|>" + long):
        assert codec.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(codec.encode(" " * 2_000_000 + "end")) > 1


def plain_differenced(lengths, windows):
    """The method on lists of windows that hold their pieces."""
    parts = [(n, -i, sorted([(n, [i])] + [(0, [])] * (windows - 1), key=lambda w: -w[0])) for i, n in enumerate(lengths)]
    made = len(lengths)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-p[0], -p[1]))
        (_, _, a), (_, _, b) = parts[:2]
        both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        both.sort(key=lambda w: -w[0])
        least = both[-1][0]
        both = [(n - least, items) for n, items in both]
        parts = parts[2:] + [(both[0][0], -made, both)]
        made += 1
    return sorted(sorted(items) for _, items in parts[0][2])


def test_differencing_equals_a_plain_one():
    r = random.Random(4)
    for windows in (1, 2, 3, 7, 16):
        for n in (1, 2, 5, 40, 90):
            # So long that no two differences are equal: which of them comes first is not told.
            lengths = [r.randrange(1, 10 ** 9) for _ in range(n)]
            found = packing.differenced(lengths, windows)
            got = sorted([i for i, w in enumerate(found) if w == k] for k in range(windows))
            assert got == plain_differenced(lengths, windows)


def test_a_window_is_added_when_one_runs_over():
    assert packing.packed([600, 600, 600, 200]) != [0] * 4
    assert np.bincount(packing.packed([600, 600, 600, 200]), [600, 600, 600, 200]).max() <= 1024
    assert len(set(packing.packed([700, 700, 600]))) == 3  # two windows would hold 1,300


@pytest.mark.parametrize("operator", [manifest.merkle_manifest, divergence.divergence, packing.sequences])
def test_empty_tables_give_no_rows(spark, empty, operator):
    none = operator(empty)
    assert none.count() == 0 and none.columns == operator(given(spark, ROWS[:3])).columns
