import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import dedup, shingles
from labelloom.sources import staging
from tests.llm import data


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def counted(text):
    w = normal(text).split()
    if len(w) < 5:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def jaccard(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common) if a or b else 1.0


def test_shingles_equal_plain_counts():
    texts = [data.prose(n, n) for n in (0, 1, 3, 4, 5, 6, 200, 3000)] + ["a a a a a a a a a a", "", "x" * 600_000, "a b c d e " * 60_000]
    seen = {}
    total = 0
    for first, hashes, times, offsets in shingles.groups(texts):
        for k in range(len(offsets) - 1):
            own = slice(offsets[k], offsets[k + 1])
            expected = counted(texts[first + k])
            assert sorted(times[own]) == sorted(expected.values())
            assert len(set(hashes[own].tolist())) == len(expected)
            seen[first + k] = set(hashes[own].tolist())
            total += 1
    assert total == len(texts) and not seen[1] & seen[2]


def test_hash_does_not_depend_on_the_neighbours():
    text = data.prose(300, 5)
    alone = next(iter(shingles.groups([text])))
    _, hashes, _, offsets = next(iter(shingles.groups(["a b", text, ""])))
    assert alone[1].tolist() == hashes[offsets[1] : offsets[2]].tolist()
    long = " ".join([text] * 300)
    assert len(next(iter(shingles.groups([long])))[1]) == len(counted(long))


def test_samples_agree_as_often_as_texts_are_similar():
    a = data.prose(400, 1)
    b = data.edited(a, 8, 2)
    sampler, rows = dedup.Sampler(4000), []
    for text in (a, b):
        _, hashes, times, _ = next(iter(shingles.groups([text])))
        rows.append(sampler.samples(hashes, times.astype(float), np.zeros(1, np.int64))[0])
    assert abs(np.mean(rows[0] == rows[1]) - jaccard(counted(a), counted(b))) < 0.03


def family():
    """Originals with exact copies, light edits (similar to the original, not always to each other), edits of edits, and strangers."""
    rows, n = [], 0
    for f in range(4):
        base = data.prose(300, 100 + f)
        group = [base, base, base.upper() + " !"]
        group += [data.edited(base, 6, 1000 * f + k) for k in range(25)]
        far = data.edited(base, 14, 77 + f)  # not similar to the original
        group += [far] + [data.edited(far, 3, 2000 * f + k) for k in range(6)]
        for text in group:
            rows.append((n, text))
            n += 1
    for k in range(60):
        rows.append((n, data.prose(120, 5000 + k)))
        n += 1
    rows += [(n, "short text"), (n + 1, "Short  text!"), (n + 2, "other text")]
    return rows


def classes_by_brute_force(rows):
    own = {k: counted(t or "") for k, t in rows}
    root = {k: k for k in own}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(own, 2):
        if jaccard(own[a], own[b]) >= 0.8:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {k: find(k) for k in own}


def test_classes_equal_brute_force(spark):
    rows = family()
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = classes_by_brute_force(rows)
    # Weights differ a little from plain counts, so only pairs away from the threshold decide.
    own = {k: counted(t) for k, t in rows}
    for a, b in itertools.combinations(own, 2):
        s = jaccard(own[a], own[b])
        if s >= 0.83:
            assert found[a] == found[b], (a, b, s)
    merged = {}
    for k, c in found.items():
        merged.setdefault(c, set()).add(expected[k])
    assert sum(len(v) for v in merged.values()) <= len(set(expected.values())) + 1
    assert set(found.values()) <= set(found)


def test_documents_of_the_test_data(spark):
    docs = data.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(docs).collect()}
    assert found == classes_by_brute_force(rows)


def test_odd_inputs(spark):
    found = dedup.near_duplicates(data.odd(spark)).collect()
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in found) == [(-1, -1), (1, 1), (1, 1), (2, 2), (3, 2), (4, 4), (5, 5)]
    kept = dedup.keep_one(data.odd(spark))
    assert kept.columns == data.odd(spark).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 4, 5]
    assert dedup.near_duplicates(data.empty(spark)).count() == 0 and dedup.keep_one(data.empty(spark)).count() == 0


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (3, 4), (5, 6)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 60)], []])
def test_components(spark, edges):
    frame = spark.createDataFrame(edges, "a long, b long")
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = {k: new if v == old else v for k, v in root.items()}
    found = {r.node: r.root for r in dedup.components(frame).collect()}
    assert all(found.get(k, k) == v for k, v in root.items())


def class_of_pairs(spark, monkeypatch, texts, pairs):
    """Classes if the bands give just these (node, hub) pairs."""
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    from pyspark.sql import functions as F

    words = dedup.normalised(F.col("text"))
    nodes = {r.doc_id: r.node for r in df.select("doc_id", dedup.node_of(F.col("text"), words).alias("node")).collect()}
    first = spark.createDataFrame([(nodes[a], nodes[b]) for a, b in pairs], "node long, hub long")
    monkeypatch.setattr(dedup, "hub_pairs", lambda bands: first)
    return {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()}


def test_copies_that_are_both_unlike_their_hub(spark, monkeypatch):
    a = data.prose(200, 1)
    texts = {1: a, 2: data.edited(a, 2, 5), 3: a + " " + data.prose(600, 2), 4: data.prose(200, 8)}
    assert jaccard(counted(texts[1]), counted(texts[3])) < 0.5 and jaccard(counted(texts[1]), counted(texts[2])) > 0.83
    assert class_of_pairs(spark, monkeypatch, texts, [(1, 3), (2, 3), (4, 3)]) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pairs_of_a_hub_count_in_either_direction(spark, monkeypatch):
    a = data.prose(200, 1)
    texts = {1: a, 2: data.edited(a, 2, 5), 3: data.edited(a, 8, 9)}
    assert class_of_pairs(spark, monkeypatch, texts, [(3, 1), (2, 3)])[2] == 1


@pytest.mark.parametrize("most", [1, 3])
def test_large_buckets_give_the_same_classes(spark, monkeypatch, most):
    df = spark.createDataFrame(family(), "doc_id long, text string")
    expected = {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(dedup, "SMALL", most)
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()} == expected


def test_small_buckets_need_no_rounds(spark, monkeypatch):
    """Edits of an original that is not there, similar to each other or not, are settled by one comparison of all pairs."""
    bases = [data.prose(300, 900 + f) for f in range(3)]
    rows = [(10 * f + k, data.edited(base, 9, 100 * f + k)) for f, base in enumerate(bases) for k in range(9)]
    rows += [(10 * f + 9, data.edited(rows[9 * f + 4][1], 2, f)) for f in range(3)]
    monkeypatch.setattr(dedup, "further_pairs", lambda *_: pytest.fail("another round"))
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    own = {k: counted(t) for k, t in rows}
    links = [(a, b) for a, b in itertools.combinations(own, 2) if jaccard(own[a], own[b]) >= 0.83]
    assert links and all(found[a] == found[b] for a, b in links)
    assert len({found[k] for k in own}) > 9


class PlainWeights:
    def of(self, hashes, times):
        return times * np.ones(len(hashes))


def test_similarities_of_blocks_equal_plain_counts(monkeypatch):
    base = data.prose(200, 4)
    texts = [data.edited(base, n, n) for n in range(20)] + [base + " a b c d e" * n for n in (1, 40)] + [data.prose(150, 9), "two words", "x"]
    own = [counted(t) for t in texts]
    words = [normal(t) for t in texts]
    for columns, pairs, dense in ((512, 1 << 20, 100), (3, 7, 2), (3, 7, 1 << 20)):
        monkeypatch.setattr(dedup, "COLUMNS", columns), monkeypatch.setattr(dedup, "PAIRS", pairs), monkeypatch.setattr(dedup, "DENSE", dense)
        found = dedup.similarities(words[:15], words[5:], PlainWeights())
        expected = [[jaccard(a, b) for b in own[5:]] for a in own[:15]]
        assert np.allclose(found, expected, rtol=0, atol=1e-12)


def test_links_that_join_classes():
    alike = np.array([[1, 1, 0, 0, 0], [0, 1, 1, 0, 0], [0, 0, 0, 1, 1]], bool)
    assert dedup.joining(alike, np.array([1, 2, 3]), np.array([1, 5, 6, 7, 7])) == [(0, 1), (1, 1), (1, 2), (2, 3)]


@pytest.mark.parametrize(("most", "of_block"), [(1, 5), (3, 5), (1, 40)])
def test_groups_of_many_blocks_give_the_same_classes(spark, monkeypatch, most, of_block):
    df = spark.createDataFrame(family(), "doc_id long, text string")
    expected = {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()}
    monkeypatch.setattr(dedup, "SMALL", most), monkeypatch.setattr(dedup, "BLOCK", of_block)
    assert {r.doc_id: r.class_id for r in dedup.near_duplicates(df).collect()} == expected


def test_rows_of_a_large_group_grow_with_its_members(spark, monkeypatch):
    """Copies of one original, many unlike it: no table has more rows than the buckets have members and the small ones pairs."""
    base = data.prose(150, 31)
    texts = [base, *(data.edited(base, 1 + k % 12, k) for k in range(400))]
    staged = []

    def counting(frame, name):
        out = staging.stage(frame, name)
        staged.append((name, out.count()))
        return out

    monkeypatch.setattr(dedup, "stage", counting), monkeypatch.setattr(dedup, "SMALL", 2)
    found = {r.doc_id: r.class_id for r in dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    members = max(n for name, n in staged[:2] if name == "dedup-members")
    assert max(n for _, n in staged) <= members
    own = [counted(t) for t in texts]
    for a, b in itertools.combinations(range(len(own)), 2):
        if jaccard(own[a], own[b]) >= 0.83:
            assert found[a] == found[b]


def test_staging_leaves_no_shuffle_files(spark):
    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(k).getName() for k in range(found.size()) if found.apply(k).getName().startswith("shuffle_")}

    before, was = files(), spark.conf.get(staging.CLEAN_UP, None)
    staged = staging.stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and staged.count() == 7
    assert spark.conf.get(staging.CLEAN_UP, None) == was
