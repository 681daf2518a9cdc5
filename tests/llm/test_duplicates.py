import random
import uuid
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import formdup, history, neardup, partenum, profiles
from termloom.llm import textform as tf
from termloom.plans.lineage import shared_dir
from termloom.sources.files import Files


def test_folding_words_and_forms():
    assert tf.fold("Ｔｈｅ­ ﬁle_name") == "the file_name"
    assert tf.words_of("the file_name 3.5") == ["the", "file", "name", "3", "5"]
    same = [("The  cat!", "the CAT"), ("title: A b | body: C", "Body = c; TITLE: a, b"), ("title: a\nbody: c", "body: c\ntitle: a"), ("ﬁne​ x", "FINE X")]
    assert all(profiles.same_in_form(a, b) for a, b in same)
    other = [("the cat", "the cats"), ("title: a | body: b", "title: b | body: a"), ("", ""), ("...", "..."), (None, None), ("body: a b", "a body b"), ("x title: a | body: b", "x body: b | title: a")]
    assert not any(profiles.same_in_form(a, b) for a, b in other)
    assert profiles.key_of(" Doc_1\t\r\n") == profiles.key_of("doc_1") != profiles.key_of("doc1") and profiles.key_of(None) is None


def test_shingles_ignore_order_of_repeats():
    a = tf.shingle_set("a b c d a b c", 3)
    assert len(a) == 4 and np.array_equal(a, np.unique(a)) and len(tf.shingle_set("a b", 3)) == 0


TEXTS = [
    (0, "Alpha beta gamma."), (1, "ALPHA, beta gamma"), (2, "alpha beta delta"), (3, None), (4, ""), (5, "?!"), (6, "?!"),
    (7, "title: One | body: Two words"), (8, "body: two WORDS; title= one"), (9, "title one body two words"), (10, "Body: Two words\ntitle: one"),
    (11, "title: x | topic: y"), (12, "topic: y | title: x"), (None, "alpha beta gamma"), (14, "x" * 300_000), (15, ("x" * 300_000).upper()), (16, "topicytitlex"),
]


def test_form_copies_and_collapse(spark):
    df = spark.createDataFrame([(i, t, "k", "l1") for i, t in TEXTS], "ordinal bigint, text string, copies string, l1 string").repartition(3)
    pairs = {(r.kept, r.copy) for r in formdup.form_copies(df).collect()}
    assert pairs == {(0, 1), (7, 8), (7, 9), (7, 10), (11, 12), (11, 16), (14, 15)}
    rows = {r.ordinal: r.copies for r in formdup.collapse(df).collect()}
    assert rows[0] == 2 and rows[7] == 4 and rows[11] == 3 and rows[4] == 1 and 1 not in rows and 3 in rows and len(rows) == 10
    empty = df.limit(0)
    assert formdup.form_copies(empty).collect() == [] and formdup.collapse(empty).collect() == []


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "a b", "A, b"), (2, "a b", "c"), (3, "title: a|body: b", "body: b|title: a")], "id bigint, a string, b string")
    assert [r.id for r in texts.mapInArrow(formdup._differ, "id bigint").collect()] == [2]
    # two contents under one fingerprint: the class is split
    forms = spark.createDataFrame([(i, 1, 1, None, None) for i in (1, 2, 3)], profiles.FORM_SCHEMA)
    classes = formdup.form_classes(forms).collect()
    assert len(classes) == 1 and classes[0].kept == 1 and classes[0].n == 3

    def colliding(batches):
        for batch in batches:
            n = len(batch)
            ones, none = pa.array([1] * n, pa.int64()), pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), ones, ones, none, none], names=["id", "l1", "l2", "m1", "m2"])

    monkeypatch.setattr(profiles, "forms", colliding)
    df = spark.createDataFrame([(1, "a b"), (2, "A, b"), (3, "c")], "ordinal bigint, text string")
    assert [tuple(r) for r in formdup.form_copies(df).collect()] == [(1, 2)]


def test_field_links_to_the_kept_row_are_verified(spark, monkeypatch):
    def colliding(batches):
        for batch in batches:
            ids, ones = batch.column(0), pa.array([1] * len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, ids, ids, ones, ones], names=["id", "l1", "l2", "m1", "m2"])

    monkeypatch.setattr(profiles, "forms", colliding)
    df = spark.createDataFrame([(1, "title: a|body: b"), (2, "title: c|body: d"), (3, "body: b|title: a")], "ordinal bigint, text string")
    assert [tuple(r) for r in formdup.form_copies(df).collect()] == [(1, 3)]


def _texts(rng, n, words=40, vocabulary=60):
    out = []
    for i in range(n):
        if out and rng.random() < 0.6:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 6)):
                k = rng.randrange(len(w) + 1)
                if rng.random() < 0.5 and len(w) > 1:
                    w.pop(min(k, len(w) - 1))
                else:
                    w.insert(k, f"w{rng.randrange(vocabulary)}")
            text = " ".join(w)
            text = text.upper() + "!" if rng.random() < 0.2 else text
        else:
            text = " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, words)))
        out.append(text)
    return out


def _set(text, k):
    w = tf.words_of(tf.fold(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _similar(a, b, g):
    common = len(a & b)
    return bool(a and b) and common >= Fraction(str(g)) * (len(a) + len(b) - common)


def _brute(rows, k, g):
    sets = [(i, t, _set(t, k)) for i, t in rows if i is not None]
    return {(min(i, j), max(i, j)) for x, (i, a, s) in enumerate(sets) for j, b, t in sets[:x] if i != j and _similar(s, t, g) and not profiles.same_in_form(a, b)}


@pytest.mark.parametrize(("k", "g"), [(3, 0.6), (5, 0.8), (1, 0.9), (2, 0.5)])
def test_near_pairs_against_brute_force(spark, k, g):
    rng = random.Random(k)
    rows = list(enumerate(_texts(rng, 120)))
    rows += [(200, None), (201, ""), (202, "one"), (None, rows[0][1]), (203, rows[0][1]), (204, rows[0][1].upper()), (205, " ".join(f"v{i}" for i in range(5000))), (206, " ".join(f"v{i}" for i in range(1, 5000)))]
    df = spark.createDataFrame([(i, t, "id", "s1") for i, t in rows], "ordinal bigint, text string, id string, s1 string").repartition(3)
    found = [(r.a, r.b) for r in neardup.near_pairs(df, shingle=k, threshold=g).collect()]
    assert len(found) == len(set(found)) and set(found) == _brute(rows, k, g)


def test_labelled_fields_in_another_order_are_no_near_pair(spark):
    a, b = "title: a b c d e f g | body: h i j k l m n o p", "body: h i j k l m n o p | title: a b c d e f g"
    df = spark.createDataFrame([(1, a), (2, b), (3, a + " q")], "ordinal bigint, text string")
    assert {(r.a, r.b) for r in neardup.near_pairs(df, shingle=3, threshold=0.6).collect()} == _brute([(1, a), (2, b), (3, a + " q")], 3, 0.6)


def test_near_classes(spark):
    rng = random.Random(9)
    rows = list(enumerate(_texts(rng, 80))) + [(100, None), (101, "x")]
    df = spark.createDataFrame(rows, "ordinal bigint, text string")
    found = {r.id: (r.class_id, r.links) for r in neardup.near_classes(df, shingle=3, threshold=0.6).collect()}
    pairs = _brute(rows, 3, 0.6)
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    form = {i: (profiles.form_of(t)[0], frozenset(_set(t, 3))) for i, t in rows}
    groups = defaultdict(list)
    for i, _ in rows:
        if form[i][1]:
            groups[form[i]].append(i)
    for same in groups.values():
        for i in same:
            parent[max(root(same[0]), root(i))] = min(root(same[0]), root(i))
    assert found == {i: (root(i), len({form[b if a == i else a] for a, b in pairs if i in (a, b)})) for i, _ in rows}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)] + [(300 + i, 301 + i) for i in range(60)] + [(400, 400 + i) for i in range(1, 40)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    found = [tuple(r) for r in neardup.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()]
    assert len(found) == len(parent) and dict(found) == {x: root(x) for x in parent}


@pytest.mark.parametrize("g", [0.6, 0.8, 0.9])
def test_similar_sets_share_a_signature(g):
    rng = np.random.default_rng(int(g * 100))
    make = partenum.Signatures(g)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        drop = rng.random(len(a)) < rng.random() * (1 - g)
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 2**63, int(rng.integers(0, n // 3 + 1)), dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if common >= Fraction(str(g)) * (len(a) + len(b) - common):
            level = lambda x: (x % np.uint64(7)).astype(np.uint8)
            all_ = lambda x: np.ones(len(x), dtype=bool)
            assert len(np.intersect1d(make.of(a, level(a), all_(a)), make.of(b, level(b), all_(b))))


def test_coarse_plans_exist_for_high_thresholds_only():
    assert partenum.plan(100, Fraction(4, 5)) and not partenum.plan(100, Fraction(3, 5)) and not partenum.plan(3, Fraction(4, 5))
    for bad in (0, 1.2, -1):
        with pytest.raises(ValueError):
            partenum.fraction(bad)


def test_set_sizes_with_parts_at_the_default_threshold():
    make = partenum.Signatures(0.8)
    kinds = lambda n: [make.plans[at] is not None for at in range(make.band_of(n), make.band_of(n) + 2)]
    for sizes, parts in (((1, 3, 567, 5000), [False, False]), ((4, 5), [False, True]), ((6, 452), [True, True]), ((453, 566), [True, False])):
        assert all(kinds(n) == parts for n in sizes)


def _known(history_rows, batch, k, g):
    ids, texts, out = set(), [], {}

    def accept(key, text):
        if key is not None:
            ids.add(key.strip(" \t\r\n").lower())
        texts.append((text, _set(text, k)))

    for _, key, text in history_rows:
        accept(key, text)
    for n, key, text in sorted(batch):
        if key is not None and key.strip(" \t\r\n").lower() in ids:
            out[n] = "doc_id"
        elif any(profiles.same_in_form(text, t) for t, _ in texts):
            out[n] = "copy"
        elif any(_similar(_set(text, k), s, g) for _, s in texts):
            out[n] = "near"
        else:
            accept(key, text)
    return out


SCHEMA = "n bigint, doc_id string, text string, id string, kind string"


def _batch(rng, first, n, ids=30):
    texts = _texts(rng, n)
    odd = [None, "", "!!"]
    return [(first + i, rng.choice([None, "", f"d{rng.randrange(ids)}", f" D{rng.randrange(ids)}\n", f"u{first + i}"]) if rng.random() < 0.5 else f"u{first + i}", rng.choice(odd) if rng.random() < 0.1 else t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("k", "g", "seed"), [(3, 0.6, 1), (5, 0.8, 2)])
def test_history_against_brute_force(spark, k, g, seed):
    rng = random.Random(seed)
    old, one, two = _batch(rng, 0, 60), _batch(rng, 0, 60), _batch(rng, 60, 60)
    old[0] = (0, "a", one[3][2])  # history and batch overlap
    frame = lambda rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    path = lambda: f"{shared_dir(spark)}/h-{uuid.uuid4().hex}"
    expected = _known(old, one + two, k, g)
    whole = history.History.create(spark, path(), frame(old), "n", "doc_id", "text", shingle=k, threshold=g)
    known, _ = whole.check(frame(one + two), "n")
    assert {r.row_no: r.reason for r in known.collect()} == expected
    # batch by batch, with the first one absorbed as a run, before and after compaction
    found = {}
    known, batch = whole.check(frame(one), "n")
    found |= {r.row_no: r.reason for r in known.collect()}
    whole.absorb(known, batch)
    again, _ = whole.check(frame(two), "n")
    whole.compact()
    compacted, _ = whole.check(frame(two), "n")
    second = {r.row_no: r.reason for r in again.collect()}
    assert len(whole.runs) == 1 and second == {r.row_no: r.reason for r in compacted.collect()}
    assert found | second == expected


@pytest.mark.parametrize(("k", "g", "words"), [(3, 0.6, 40), (5, 0.8, 14), (5, 0.8, 700)])
def test_batch_is_checked_against_new_texts_of_absorbed_batches(spark, k, g, words):
    text = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    frame = lambda *rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    path = f"{shared_dir(spark)}/h-{uuid.uuid4().hex}"
    h = history.History.create(spark, path, frame((0, "a", text("o", words))), "n", "doc_id", "text", shingle=k, threshold=g)
    known, batch = h.check(frame((0, "b", text("v", words))), "n")
    assert known.collect() == []
    h.absorb(known, batch)
    two = frame((1, "c", text("v", words - 1)), (2, "d", text("o", words - 1)), (3, "e", text("u", words)))
    expected = {(1, "near"), (2, "near")}
    assert {tuple(r) for r in h.check(two, "n")[0].collect()} == expected
    assert {tuple(r) for r in history.History.open(spark, path).check(two, "n")[0].collect()} == expected


def test_history_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    h = history.History.create(spark, f"{shared_dir(spark)}/h-{uuid.uuid4().hex}", empty, "n", "doc_id", "text")
    assert h.check(empty, "n")[0].collect() == []
    known, _ = h.check(spark.createDataFrame([(0, "a", "t", "", ""), (1, "A ", "u", "", ""), (None, "a", "t", "", "")], SCHEMA), "n")
    assert [tuple(r) for r in known.collect()] == [(1, "doc_id")]


def test_scanned_words_and_shingles_against_brute_force(monkeypatch):
    rng = random.Random(3)
    alphabet = "abcßя語ก्é_-., \n𝐀𝟙😀̀"
    texts = ["", " ", "x", "ab " * 50, "y" * 300, *("".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(200))]
    monkeypatch.setattr(tf, "GROUP_CHARS", 100)  # texts longer than a group, and words longer than one
    groups = list(tf.groups(texts))
    assert [i for a, b in groups for i in range(a, b)] == list(range(len(texts))) and len(groups) > 10
    hash_of, letters_of = {}, {}
    for a, b in groups:
        hashes, counts, letters = tf.scan(texts[a:b])
        words = [tf.words_of(t) for t in texts[a:b]]
        assert counts.tolist() == [len(w) for w in words]
        for word, h in zip((x for w in words for x in w), hashes.tolist(), strict=True):
            assert hash_of.setdefault(word, h) == h
        for w, digest in zip(words, letters.tolist(), strict=True):
            assert letters_of.setdefault("".join(w), digest) == digest
        for n in (1, 3):
            features, sizes = tf.shingle_sets(hashes, counts, n)
            at = 0
            for w, size in zip(words, sizes.tolist(), strict=True):
                own = features[at : at + size]
                assert size == len({tuple(w[i : i + n]) for i in range(len(w) - n + 1)}) and np.array_equal(own, np.unique(own))
                at += size
    assert len(set(hash_of.values())) == len(hash_of) and len({tuple(d) for d in letters_of.values()}) == len(letters_of)
    assert [len(x) for x in tf.scan([])] == [0, 0, 0]


def test_runs_are_merged_and_given_up(spark, monkeypatch):
    monkeypatch.setattr(history, "MOST_RUNS", 1)
    text = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    frame = lambda *rows: spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    path = f"{shared_dir(spark)}/h-{uuid.uuid4().hex}"
    h = history.History.create(spark, path, frame((0, "a", text("o", 30)), (1, "a2", text("p", 30))), "n", "doc_id", "text", shingle=3, threshold=0.6)
    # the set of 1 and 2 is written with 1, which is refused by its identifier
    known, batch = h.check(frame((1, "A", text("v", 30)), (2, "b", text("v", 30)), (3, "c", None), (4, "d", text("q", 30))), "n")
    assert {tuple(r) for r in known.collect()} == {(1, "doc_id")}
    h.absorb(known, batch)
    assert len(h.runs) == 1 and sorted(n for n in Files(spark).list(path) if n.startswith("run-")) == [h.runs[0].rsplit("/", 1)[1]]
    three = frame((5, "e", text("o", 29)), (6, "f", text("v", 29)), (7, "C ", "new"), (8, "g", text("q", 30).upper()), (9, "h", text("w", 30)), (10, "i", text("w", 29)))
    expected = {(5, "near"), (6, "near"), (7, "doc_id"), (8, "copy"), (10, "near")}
    assert {tuple(r) for r in h.check(three, "n")[0].collect()} == expected
    h.compact()
    assert {tuple(r) for r in history.History.open(spark, path).check(three, "n")[0].collect()} == expected
    assert sum(n.startswith("order-") for n in Files(spark).list(path)) == 1
