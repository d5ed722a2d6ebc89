import zlib
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import common, hosts, quality
from tests import oracle
from tests.llm import data


def test_host_query(spark, sf_dir):
    message, _, rows = oracle.compare(spark, oracle.connect(sf_dir), "op7", hosts.op7_host_rules, common.SQL["op7_host_rules"], sf_dir)
    assert message is None and rows > 0


def plain(text):
    w = text.encode().split()
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(common.BLANK)]
    return len(w), sum(c not in common.BLANK for c in text), sum(c in hosts.SYMBOLS for c in text), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("text", ["", " \n ", "a b c", "a b c a b c", "x\nx\n\n\nx ", "é # é | é", "a a a a", "one two   three"])
def test_measures(text):
    assert hosts.measures(text) == plain(text)


def test_bad_host_is_rejected_and_small_hosts_are_shrunk(spark):
    good, bad = data.prose(80, 1), "too short"
    rows = [(i, good, "good") for i in range(60)] + [(100 + i, bad, "bad") for i in range(40)] + [(200, good, "bad")]
    rows += [(300, bad, "one"), (301, good, None), (302, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in hosts.judge(df).collect()}
    assert len(found) == len(rows)
    assert not found[200].base_failed and not found[200].kept and found[0].kept
    assert 0.5 < found[300].rate < 1 and found[302].base_failed


def test_odd_inputs_of_hosts(spark):
    rows = hosts.judge(data.odd(spark)).collect()
    assert len(rows) == len(data.odd_rows())
    assert sum(r.n_words == 0 and r.base_failed for r in rows) == 3
    assert hosts.judge(data.empty(spark)).count() == 0


# --- quality -------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality.op8_quality(spark, folder).join(data.table(spark, folder, "labels"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.held_out for r in held) and sum(r.held_out for r in rows) == len(held)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and (r.predicted == 1) == (r.score >= 0.3) for r in rows)


def test_labels_of_held_out_rows_do_not_matter(spark, sf_dir):
    docs, labels = data.table(spark, sf_dir, "documents"), data.table(spark, sf_dir, "labels")
    turned = labels.withColumn("quality", (1 - labels.quality) * (~common.is_training("doc_id", 0)).cast("int") + labels.quality * common.is_training("doc_id", 0).cast("int"))
    one = {r.doc_id: r.score for r in quality.rank(docs, labels).collect()}
    assert one == {r.doc_id: r.score for r in quality.rank(docs, turned).collect()}


def test_fit_orders_pairs():
    draw = np.random.default_rng(1)
    y = (draw.random(400) < 0.8).astype(int)
    x = draw.normal(size=(400, 3)) + np.array([3.0, 0, 0]) * y[:, None]
    model = quality.fit(x, y)
    w = model.worths(x)
    assert np.mean(w[y == 1][:, None] > w[y == 0]) > 0.9
    assert abs(np.mean(w < model.threshold) - np.mean(y == 0)) < 1e-9
    assert quality.fit(x, np.ones(400)) is None


def test_fit_equals_plain_descent():
    """The logistic loss over the same pairs, pair by pair, by plain gradient descent."""
    draw = np.random.default_rng(4)
    y = (draw.random(60) < 0.6).astype(int)
    x = draw.normal(size=(60, 3)) * [1.0, 5.0, 0.2] + np.outer(y, [0.8, 2.0, 0.0])
    model = quality.fit(x, y, partners=3, decay=1e-2, seed=5)
    random, good, bad = np.random.default_rng(5), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    left = [*np.repeat(good, 3), *random.choice(good, 3 * len(bad))]
    right = [*random.choice(bad, 3 * len(good)), *np.repeat(bad, 3)]
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    weights = np.zeros(3)
    for _ in range(4000):
        step = np.zeros(3)
        for a, b in zip(left, right):
            step += (z[a] - z[b]) / (1 + np.exp((z[a] - z[b]) @ weights))
        weights += 0.5 * (step / len(left) - 1e-2 * weights)
    assert np.abs(np.array(model.weights) - weights).max() < 1e-6


def test_labelled_rows_are_bounded(spark, sf_dir, monkeypatch):
    docs, labels = data.table(spark, sf_dir, "documents"), data.table(spark, sf_dir, "labels")
    seen, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    for most in (0, 20, 10**6):
        quality.rank(docs, labels, most_labelled=most).count()
    usable = docs.join(labels, "doc_id").filter(common.is_training("doc_id", 0)).count()
    assert seen[0] <= 20 and seen[1] == usable > 20


def test_odd_inputs_of_quality(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (4, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.rank(data.odd(spark), labels).collect()
    assert len(rows) == len(data.odd_rows()) and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    assert quality.keep_good(data.odd(spark), labels).count() == len(rows)
    assert quality.rank(data.empty(spark), labels).count() == 0
    assert quality.rank(data.odd(spark), labels.limit(0)).count() == len(rows)


def test_keep_good_agrees_with_rank(spark, sf_dir):
    docs, labels = data.table(spark, sf_dir, "documents"), data.table(spark, sf_dir, "labels")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.rank(docs, labels).filter("predicted = 1").collect()}


def test_all_labelled_rows_count_beyond_the_driver(spark, sf_dir):
    """With more labelled rows than the driver takes, cut and weights are those of all of them."""
    docs, labels = data.table(spark, sf_dir, "documents"), data.table(spark, sf_dir, "labels")
    every, few = (quality.rank(docs, labels, most_labelled=most).join(labels, "doc_id").collect() for most in (10**6, 20))
    trained = [r for r in few if not r.held_out]
    assert sum(r.predicted == 0 for r in trained) == sum(r.quality == 0 for r in trained) > 0
    a, b = (np.array([r.worth for r in sorted(rows, key=lambda r: r.doc_id)]) for rows in (every, few))
    assert np.corrcoef(a, b)[0, 1] > 0.99


def test_fit_of_a_table(spark, tmp_path, monkeypatch):
    """Groups of rows with a rare class: pairs of every row, and the weights of a fit in memory on the same pairs."""
    monkeypatch.setattr(quality, "GROUP", 50)
    monkeypatch.setattr(quality, "GROUP_RARE", 4)
    draw = np.random.default_rng(2)
    y = (draw.random(900) < 0.98).astype(int)
    x = draw.normal(size=(900, len(quality.NAMES))) + np.outer(y, np.eye(len(quality.NAMES))[0])
    order = draw.integers(-(2**62), 2**62, 900)
    rows = [(int(o), r.tolist(), int(k)) for o, r, k in zip(order, x, y)]
    table = spark.createDataFrame(rows, "_order long, x array<double>, _label int")
    groups = quality._grouped(table, {0: int((y == 0).sum()), 1: int((y == 1).sum())}).collect()
    own = [r["_order"] for g in groups for r in g.rows if r["_own"]]
    assert len(groups) == 18 and sorted(own) == sorted(order.tolist())
    z, differences = (x - x.mean(axis=0)) / x.std(axis=0), []
    at = {int(o): k for k, o in enumerate(order)}
    for g in groups:
        k = [at[r["_order"]] for r in g.rows]
        random = np.random.default_rng([5, g["_group"]])
        differences.append(quality._differences(z[k], y[k], np.array([r["_own"] for r in g.rows]), 3, random))
    difference = np.concatenate(differences)
    assert len(difference) == 3 * 900
    weights = quality._newton(np.zeros(x.shape[1]), lambda w: quality._pair_sums(difference, w), 1e-2)
    model = quality.fit_table(table, partners=3, decay=1e-2, seed=5)
    assert np.abs(np.array(model.weights) - weights).max() < 1e-9
    assert (model.worths(x) < model.threshold).sum() == (y == 0).sum()
    assert quality.fit_table(table.filter("_label = 1")) is None
