import base64
import hashlib
import random
import textwrap
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterquarry.llm import bpe, ctph, licenses, mixing, quality_classifier, quality_rules, simhash, substring_dedup, wordpiece
from rasterquarry.llm.queries import BYTE_RANKS, PIECES

from . import brute

NULLS = [(None, None, None), (None, "a b", None), (5, None, "s"), (5, None, "s"), (6, "", None)]


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1 document fingerprints


def test_fingerprints(docs, corpus):
    got = {r.doc_id: r for r in ctph.fingerprints(docs).collect()}
    assert len(got) == len(corpus)
    for i, (k, text, _) in enumerate(corpus):
        text, after = text or "", corpus[(i + 1) % len(corpus)][1] or ""
        new = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (ctph.fingerprint(text), ctph.fingerprint(new))
        assert r.near_edited == ctph.likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == ctph.likeness(r.fingerprint, ctph.fingerprint(after))
        if len(text) + len(after) < 6000:  # plain versions are slow
            assert (r.fingerprint, r.edited_fingerprint) == (brute.fingerprint(text), brute.fingerprint(new))
            assert r.near_edited == pytest.approx(brute.likeness(r.fingerprint, r.edited_fingerprint))
            assert r.near_next == pytest.approx(brute.likeness(r.fingerprint, brute.fingerprint(after)))
    long = [r for r in got.values() if 300 < r.n_chars]
    assert np.mean([r.near_edited for r in long]) > 0.4


def test_fingerprints_of_many_ranges_agree_with_one(docs):
    assert sorted(rows(ctph.fingerprints(docs, 9))) == sorted(rows(ctph.fingerprints(docs.coalesce(1), 1000)))


def test_fingerprints_edges(make, none):
    assert rows(ctph.fingerprints(none)) == []
    one = ctph.fingerprints(make([(1, "abc", None)])).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"aba").hexdigest()
    got = ctph.fingerprints(make(NULLS)).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 0), (False, 0), (False, 0), (True, 0), (True, 3)]


def levenshtein(a, b):
    """Edits that add or take one character."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(row[j], row[j - 1])
    return row[-1]


@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
@settings(max_examples=60, deadline=None)
def test_common_subsequence_is_the_edit_distance(a, b):
    assert len(a) + len(b) - 2 * ctph._common(a, b) == levenshtein(a, b)


@given(st.binary(min_size=1, max_size=300))
@settings(max_examples=40, deadline=None)
def test_rolling_hash_sees_its_window_only(data):
    whole = ctph._rolling(np.frombuffer(data, np.uint8))
    for i in range(len(data)):
        if i >= ctph.WINDOW - 1:
            part = np.frombuffer(data[i - ctph.WINDOW + 1 : i + 1], np.uint8)
            assert ctph._rolling(part)[-1] == whole[i]


# 2 mixing


def check_mix(got, table):
    sizes = {}
    for _, s, n in table:
        sizes[s] = sizes.get(s, 0) + n
    goal, taken = brute.targets(sizes), brute.mix(table)
    source = {k: s for k, s, _ in table}
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        assert r.taken == taken[r.doc_id] and 0 <= r.taken <= 3 * r.size
    for s in sizes:
        assert sum(r.taken for r in got if source[r.doc_id] == s) == int(goal[s] + 0.5)


def test_mix(docs, corpus):
    check_mix(mixing.mix(docs).collect(), [(k, s, len(brute.split(t))) for k, t, s in corpus])


def test_mix_reshares_what_small_sources_cannot_give(make):
    table = [(k, "abcdefg"[min(k % 40, 6)], f"w {'v ' * (k % 11)}") for k in range(300)]
    check_mix(mixing.mix(make([(k, t, s) for k, s, t in table])).collect(), [(k, s, len(t.split())) for k, s, t in table])


def test_mix_edges(make, none):
    assert rows(mixing.mix(none)) == []
    got = sorted(rows(mixing.mix(make(NULLS))), key=str)
    assert len(got) == 5 and all(r[4] <= 3 * r[1] for r in got)
    copies = rows(mixing.mix(make([(1, "a b c", "x")] * 4 + [(2, "a", "y")])))
    assert all(r[4] <= 3 * r[1] for r in copies) and all(0 <= r[3] + 0.5 - sum(c[4] for c in copies if c[0] == r[0]) <= 5 for r in copies)


def test_mixed_rows_hold_what_is_taken(docs, corpus):
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    out = mixing.mixed_rows(docs)
    assert out.dtypes == docs.dtypes
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.split(r.text))
        assert r.n_chars == len(r.text)
    assert got == {k: n for k, n in taken.items() if n}


# 3 byte-level BPE


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(BYTE_RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(BYTE_RANKS)


def test_round_trip(docs, corpus, library):
    got = {r.doc_id: r for r in bpe.round_trip(docs, BYTE_RANKS, with_ids=True).collect()}
    for k, text, _ in corpus:
        ids = library.encode_ordinary(text or "")
        assert got[k].ids == ids and got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_encode_then_decode(docs, corpus, none, make):
    back = {r.doc_id: r.content for r in bpe.decode(bpe.encode(docs, BYTE_RANKS), BYTE_RANKS).collect()}
    assert back == {k: (t or "").encode() for k, t, _ in corpus}
    assert rows(bpe.encode(none, BYTE_RANKS)) == rows(bpe.round_trip(none, BYTE_RANKS)) == []
    assert sorted(len(r[1]) for r in rows(bpe.encode(make(NULLS), BYTE_RANKS))) == [0, 0, 0, 0, 2]


@given(st.lists(st.text(st.characters(codec="utf-8", categories=None) | st.sampled_from(" \n\t' 　ſabstrevmld0123.,-"), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_pieces_are_those_of_the_pattern(texts):
    import regex

    starts, codes, distinct = bpe.pieces(texts)
    found = [distinct[c].as_py().decode() for c in codes]
    for text, a, b in zip(texts, starts[:-1], starts[1:]):
        assert found[a:b] == regex.findall(public_tokenizers.PATTERN, text)


@given(st.lists(st.text("ab -=\n0é", min_size=65, max_size=200) | st.text(min_size=1, max_size=30), min_size=1, max_size=4))
@settings(max_examples=25, deadline=None)
def test_words_merge_as_the_library_does(coder, library, texts):
    coder.known.clear()
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text)
    for text in texts:
        word = text.replace(" ", "").encode()[:150]
        if word:  # uncut
            coder.known.clear()
            coder._query([word])
            assert np.frombuffer(coder.known[word], "<u4").tolist() == library._encode_single_piece(word)


@pytest.mark.parametrize("letters, n", [("abcdefghijklmnopqrstuvwxyz", 100_000), ("etaoinsr", 8_000), ("ACGT", 20_000), ("x", 100_001), ("\n ", 3_000), ("aA", 5_000)])
def test_long_words(coder, library, letters, n):
    rng = random.Random(n)
    word = "".join(rng.choice(letters) for _ in range(n))
    assert coder.encode([word])[0].tolist() == library.encode_ordinary(word)


def test_long_documents_decode_in_parts(coder, monkeypatch):
    monkeypatch.setattr(bpe, "QUERY_IDS", 7)
    ids = coder.encode(["", "one two three four five six seven eight nine ten", "x", "é😀" * 9])
    assert coder.decode(ids) == [t.encode() for t in ("", "one two three four five six seven eight nine ten", "x", "é😀" * 9)]


# 4 SimHash near-dedup


def test_near_duplicates(docs, corpus):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [brute.simhash(t) for _, t, _ in corpus]
    roots = brute.components(fps)
    assert got == {k: (f"{f:016x}", corpus[r][0]) for (k, _, _), f, r in zip(corpus, fps, roots)}


@pytest.mark.parametrize("paired", [1, 3, 32])
def test_links_of_dense_and_sparse_buckets(spark, monkeypatch, paired):
    rng = np.random.default_rng(paired)
    fps = []
    for _ in range(12):
        centre = int(rng.integers(0, 1 << 62))
        for _ in range(20):
            flips = rng.choice(64, rng.integers(0, 7), replace=False)
            fps.append(centre ^ sum(1 << int(b) for b in flips))
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    monkeypatch.setattr(simhash, "PAIRED", paired)

    def small(batches, most=paired):
        simhash.PAIRED = most
        yield from simhash._bucket_batches(batches)

    found = simhash._sorted_by(nodes.mapInArrow(simhash._probe_batches, "k long, fp long"), "k", "fp").mapInArrow(small, "k long, a long, b long").collect()
    assert all((r.a ^ r.b).bit_count() <= 4 if r.k is None and (r.a ^ r.b) >= 0 else True for r in found if r.b is not None)
    from rasterquarry.llm.graph import connected_components

    monkeypatch.setattr(simhash, "_bucket_batches", small)
    roots = {r.node: r.root for r in connected_components(simhash.links(nodes)).collect()}
    groups = {}
    for f in fps:
        s = f - (1 << 64) if f >> 63 else f
        groups.setdefault(roots.get(s, s), set()).add(f)
    want = {}
    for f, r in zip(fps, brute.components(fps)):
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_edges(make, none, docs, corpus):
    assert rows(simhash.near_duplicates(none)) == []
    assert sorted(rows(simhash.near_duplicates(make(NULLS))), key=str) == [(5, "0" * 16, 5)] * 2 + [(6, "0" * 16, 5), (None, "0" * 16, 5), (None, f"{brute.simhash('a b'):016x}", None)]
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.dtypes == docs.dtypes
    roots = brute.components([brute.simhash(t) for _, t, _ in corpus])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({corpus[r][0] for r in roots})


def test_one_row_of_each_component_stays_whatever_its_id(make):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    texts = [text() for _ in range(12)]
    table = [(None, t, "a") for t in texts[:6]] + [(7, t, "a") for t in texts[6:9]] + [(8, texts[0], "b"), (None, texts[9], "b"), (None, texts[9], "c"), (None, texts[9], "b"), (7, texts[10], "c"), (9, texts[10], "a"), (None, None, "a"), (None, "", "b")]
    got = [sorted(((r.doc_id, r.text, r.source) for r in simhash.keep_one(make(t).repartition(n)).collect()), key=str) for t, n in ((table, 1), (table[::-1], 5))]
    assert got[0] == got[1]
    assert sorted(r[1] or "" for r in got[0]) == sorted([*texts[:11], ""])
    assert {r[1]: r[0] for r in got[0]}[texts[0]] == 8 and {r[1]: r[0] for r in got[0]}[texts[10]] == 7


def test_rounds_of_few_edges_write_few_files(spark):
    from rasterquarry.llm.graph import connected_components

    most = 4 * spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", most + 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        stars = connected_components(spark.createDataFrame([(k + 1, k) for k in range(60)] + [(101, 100), (102, 100)], "a long, b long"))
        assert stars.rdd.getNumPartitions() <= most
        assert sorted(map(tuple, stars.collect())) == [(k, 0) for k in range(1, 61)] + [(101, 100), (102, 100)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_components_of_a_long_chain(spark):
    from rasterquarry.llm.graph import connected_components

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 3000)] + [(5000, 5001), (7, 7)], "a long, b long").repartition(8)
    roots = dict(rows(connected_components(edges)))
    assert roots == {i: 0 for i in range(1, 3001)} | {5001: 5000}
    assert rows(connected_components(edges.where("a > 9999"))) == []


# 5 token counts


def test_token_counts(docs, corpus, none, make):
    pieces = set(wordpiece.vocabulary(PIECES))
    got = {r.doc_id: tuple(r)[1:] for r in wordpiece.token_counts(docs, PIECES).collect()}
    for k, text, _ in corpus:
        n = [brute.greedy(w, pieces) for w in brute.split(text)]
        assert got[k] == (len(n), sum(max(1, x) for x in n), n.count(0))
    assert rows(wordpiece.token_counts(none, PIECES)) == []
    assert sorted(r[1] for r in rows(wordpiece.token_counts(make(NULLS), PIECES))) == [0, 0, 0, 0, 2]


@given(st.sets(st.tuples(st.booleans(), st.text("abc", min_size=1, max_size=4)), max_size=12), st.text("abc", min_size=1, max_size=12))
@settings(max_examples=400, deadline=None)
def test_automaton_counts_greedy_pieces(pieces, word):
    assert wordpiece.Automaton(pieces).count(word) == brute.greedy(word, pieces)


# 6 license scans


def test_license_scan(spark, make, none):
    mit = "Copyright (c) 2020 A. Person\n\n" + licenses._MIT.upper().replace(" ", "  ").replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    table = [(1, mit, None), (2, "prose\nReleased under the MIT Licence!\nmore", None), (3, "Licensed under CC BY-NC 4.0", None), (4, "I was released under the MIT License.", None), (5, None, None), (6, "", None), (3, "Licensed under CC BY-NC 4.0", None), (7, "x\n" * 50 + "© 1999 me\n", None)]
    known = licenses.known_licenses(spark)
    got = sorted(rows(licenses.scan(make(table), known)))
    assert got == [(1, "text", 0, "MIT"), (2, "line", 2, "MIT"), (3, "text", 0, "CC-BY-NC-4.0"), (3, "text", 0, "CC-BY-NC-4.0")]
    assert rows(licenses.scan(none, known)) == []
    plan = licenses.scan(make(table), known)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wrapped(text, width):
    return "\n".join(textwrap.fill(x, width) for x in text.split("\n"))


def test_known_texts_are_found_at_every_width(spark, make):
    texts = [("MIT", licenses._MIT), ("ISC", licenses._ISC), ("0BSD", licenses._ZERO)]
    heads = ["", "Copyright (c) 2020 A. Person\n\n", "Copyright 2020-2021 The Authors\nAll rights reserved.\n\n", "© 2020 A. Person\n", "Copyright The Project Authors\n\n", "(c) 2020 me\n"]
    cases = [(name, heads[w % len(heads)] + wrapped(text, w)) for name, text in texts for w in range(50, 101)]
    got = {r.doc_id: r.license for r in licenses.scan(make([(i, t, None) for i, (_, t) in enumerate(cases)]), licenses.known_licenses(spark)).where("scope = 'text'").collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}


def test_whole_licenses_are_found(spark, make):
    folder = Path(licenses.__file__).parent / "license_texts"
    cases = [(f.stem, text) for f in sorted(folder.glob("*.txt")) for text in (f.read_text(), "  " + f.read_text().replace("\n", "\n  "))]
    short = [(n, (folder / f"{n}.txt").read_text()) for n in ("BSD-2-Clause", "BSD-3-Clause", "Zlib", "Unlicense", "BSL-1.0")]
    cases += [(n, wrapped(t, w)) for n, t in short for w in range(60, 90, 3)]
    cases += [("MIT", "The MIT License\n\nCopyright (c) 2020 me\n\n" + licenses._MIT), ("ISC", "The ISC License\n\nCopyright (c) me\n\n" + wrapped(licenses._ISC, 72))]
    cases += [("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2020, me\nAll rights reserved.\n\n" + wrapped(short[1][1].replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), 79))]
    apache = (folder / "Apache-2.0.txt").read_text()
    cases += [("Apache-2.0", apache.replace("Copyright [yyyy] [name of copyright owner]", "Copyright 2020 A. Person")), ("Apache-2.0", apache.split("   APPENDIX")[0])]
    assert len({n for n, _ in cases}) >= 15
    got = {r.doc_id: r.license for r in licenses.scan(make([(i, t, None) for i, (_, t) in enumerate(cases)]), licenses.known_licenses(spark)).where("scope = 'text'").collect()}
    assert got == {i: name for i, (name, _) in enumerate(cases)}


# 7 substring dedup


def test_substring_dedup(docs, corpus, none, make):
    got = {r.doc_id: tuple(r)[1:] for r in substring_dedup.deduplicate(docs).collect()}
    want = brute.substrings([(k, t) for k, t, _ in corpus])
    assert got == {k: w for (k, _, _), w in zip(corpus, want)}
    assert any(w[2] for w in want)
    assert rows(substring_dedup.deduplicate(none)) == []
    assert sorted(rows(substring_dedup.deduplicate(make(NULLS))), key=str) == [(5, "", 0, 0)] * 2 + [(6, "", 0, 0), (None, "", 0, 0), (None, "a b", 1, 0)]
    kept = substring_dedup.keep_new(docs)
    assert kept.dtypes == docs.dtypes
    assert {r.doc_id: r.text for r in kept.collect()} == {k: w[0] for (k, _, _), w in zip(corpus, want) if not w[2] or brute.split(w[0])}


def test_rows_with_one_id_keep_their_text(make):
    text = "one two three four five six seven eight nine. ten eleven twelve thirteen fourteen fifteen sixteen seventeen. eighteen nineteen twenty one two three four five."
    out = rows(substring_dedup.deduplicate(make([(1, text, None), (1, text, None), (2, text, None)])))
    assert sorted(r[3] for r in out) == [0, 0, 3]
    # different texts without an id, or under one id, are documents of their own
    table = [(i, f"{'x' * n} y. {text} {'z' * n}", None) for i in (None, 4) for n in range(1, 9)]
    out = rows(substring_dedup.deduplicate(make(table)))
    assert sum(r[3] == 0 for r in out) == 1
    want = brute.substrings([(k, t) for k, t, _ in table])
    assert sorted((r[0] or 0, r[1]) for r in out) == sorted((k or 0, w[0]) for (k, _, _), w in zip(table, want))


def test_passages_of_long_sentences_go(make):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    some = lambda n: [word() for _ in range(n)]
    for ends in ((), (29,), (29, 59), (9, 44)):  # where the passage's sentences end
        passage = some(60)
        passage = " ".join(w + "." * (i in ends) for i, w in enumerate(passage))
        around = [[" ".join(some(15)) for _ in range(2)] for _ in range(2)]
        texts = [f"{a} {passage} {b}" for a, b in around]
        one, two = (r.text for r in sorted(substring_dedup.deduplicate(make([(i, t, None) for i, t in enumerate(texts)])).collect(), key=lambda r: r.doc_id))
        assert one == texts[0]
        left = two.split()
        assert left[:15] == around[1][0].split() and left[-15:] == around[1][1].split()
        assert len(left) <= 30 + 12
        assert " ".join(x.text for x in substring_dedup.keep_new(make([(0, passage, None), (1, passage + " " + around[0][0], None), (2, passage, None)])).collect() if x.doc_id == 1).endswith(around[0][0])


# 8 quality rules


def test_quality_rules(spark, docs, corpus, none, make):
    labels = spark.createDataFrame([(k, int(i % 2), 0) for i, (k, _, _) in enumerate(corpus[:50])] + [(corpus[0][0], 1, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    texts = [t or "" for _, t, _ in corpus]
    want = brute.quality(texts, [k in good for k, _, _ in corpus])
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for (k, t, _), (kept, score) in zip(corpus, want):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute.base_counts(t)
        assert r.score == pytest.approx(score, abs=1e-9) and r.kept == kept
    out = quality_rules.keep_good(docs, labels)
    assert out.dtypes == docs.dtypes and sorted(r.doc_id for r in out.collect()) == sorted(k for (k, _, _), w in zip(corpus, want) if w[0])
    assert rows(quality_rules.quality_rules(none, labels)) == []
    assert {(r.n_words, r.kept, r.score) for r in quality_rules.quality_rules(make(NULLS), labels.limit(0)).collect()} == {(0, False, 0.0), (2, False, 0.0)}


# 9 quality classifier


def test_classifier_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_classifier.classify(spark.read.parquet(f"{sf}/documents.parquet"), labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_classifier_edges(spark, none, make, docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (8, None)], "doc_id long, quality int")
    assert rows(quality_classifier.classify(none, labels)) == []
    got = quality_classifier.classify(make(NULLS), labels.limit(0)).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5}
    assert all(0 <= r.score <= 1 for r in quality_classifier.classify(docs, labels).collect())


def test_held_out_labels_do_not_matter(spark, docs, corpus):
    rows_ = [(k, int(len(t or "") > 200)) for k, t, _ in corpus]
    held = [zlib.crc32(str(k).encode()) % 5 == 0 for k, _ in rows_]
    a = spark.createDataFrame(rows_, "doc_id long, quality int")
    b = spark.createDataFrame([(k, 1 - q if h else q) for (k, q), h in zip(rows_, held)], "doc_id long, quality int")
    score = lambda labels: {r.doc_id: round(r.score, 9) for r in quality_classifier.classify(docs, labels).collect()}
    assert score(a) == score(b)


def test_isotonic_is_the_best_monotone_fit():
    n, hits = np.zeros(quality_classifier.BINS), np.zeros(quality_classifier.BINS)
    n[[10, 20, 30, 40]], hits[[10, 20, 30, 40]] = [1, 2, 1, 4], [1, 0, 1, 4]
    knots, values = quality_classifier._isotonic(n, hits)
    assert values.tolist() == [pytest.approx(1 / 3), 1.0] and (np.diff(knots) > 0).all()


def test_classifier_equals_its_plain_version(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(quality_classifier, "SUM_ROWS", 70)  # several tasks' sums
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghi") for _ in range(rng.randint(1, 9))) for _ in range(90)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "!!", "\n"]) for _ in range(rng.randint(0, 90))) for _ in range(400)]
    texts += texts[:30]
    truth = [int(t.count("!") < t.count(".") or rng.random() < 0.1) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, q) for i, q in enumerate(truth) if i % 3], "doc_id long, quality int")
    x = np.concatenate([quality_classifier.statistics(pa.array([t])) for t in texts]).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(len(texts))])
    train = [i for i in range(len(texts)) if i % 3 and fold[i]]
    want = brute.classifier(x[train], np.array(truth, float)[train], fold[train], x)
    got = {r.doc_id: r.score for r in quality_classifier.classify(docs, labels).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)
    assert len(set(got.values())) > 10
