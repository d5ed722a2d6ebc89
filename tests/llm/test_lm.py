import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelloom.llm import lm
from tests.llm import data


def kt(zeros, ones):
    return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)


class Tree:
    """Context trees by recursion."""

    def __init__(self, counts, depth):
        self.depth, self.bits, self.longer = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for gram, n in counts.items():
            for d in range(depth + 1):
                own = (d, (gram >> 8) & ((1 << 8 * d) - 1))
                if d < depth:
                    self.longer[own].add((d + 1, (gram >> 8) & ((1 << 8 * (d + 1)) - 1)))
                node = 1
                for k in range(7, -1, -1):
                    bit = gram >> k & 1
                    self.bits[own, node][bit] += n
                    node = 2 * node + bit

    def weighted(self, own, node):
        e = kt(*self.bits.get((own, node), (0, 0)))
        if own[0] == self.depth:
            return e
        return np.logaddexp(e, sum(self.weighted(x, node) for x in self.longer[own])) - math.log(2)

    def one(self, context, node, d=0):
        own = (d, context & ((1 << 8 * d) - 1))
        zeros, ones = self.bits.get((own, node), (0, 0))
        estimate = (ones + 0.5) / (zeros + ones + 1)
        if d == self.depth:
            return estimate
        share = math.exp(kt(zeros, ones) - math.log(2) - self.weighted(own, node))
        return share * estimate + (1 - share) * self.one(context, node, d + 1)

    def log10(self, gram):
        out, node = 0.0, 1
        for k in range(7, -1, -1):
            bit, one = gram >> k & 1, self.one(gram >> 8, node)
            out += math.log10(one if bit else 1 - one)
            node = 2 * node + bit
        return out


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_table_equals_recursion(depth):
    draw = random.Random(1)
    counts = Counter()
    for _ in range(30):
        counts.update(lm.grams(bytes(draw.choice(b"abca") for _ in range(draw.randint(0, 40))), depth).tolist())
    table = lm.code_table(np.array(list(counts), np.int64), np.array(list(counts.values()), float), depth)
    tree = Tree(counts, depth)
    for text in (b"abcab", b"zz", b"", b"a\xc3\xa9b"):
        for gram in lm.grams(text, depth).tolist():
            assert abs(table[gram] - tree.log10(gram)) < 1e-5
    sums = (10 ** table.reshape(-1, 256).astype(float)).sum(axis=1)
    assert abs(sums - 1).max() < 1e-5


def test_lgamma():
    x = np.array([0.5, 1, 1.5, 7.5, 100.5, 1e6 + 0.5])
    assert np.allclose(lm._lgamma(x), [math.lgamma(v) for v in x], rtol=1e-10, atol=1e-9)


def test_query_equals_plain_sums(spark, sf_dir):
    texts = data.texts(spark, sf_dir)
    tokens = {k: [*t.encode().lower().split(), None] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    counts, grams = Counter(), Counter()
    for k, t in texts.items():
        if not held[k]:
            counts.update(tokens[k])
            grams.update(lm.grams(lm.lowered(t), lm.DEPTH).tolist())
    n, v = sum(counts.values()), len(counts)
    table = lm.code_table(np.array(list(grams), np.int64), np.array(list(grams.values()), float))
    rows = lm.op4_context_tree(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        raw = lm.lowered(texts[r.doc_id])
        assert math.isclose(r.score, float(table[lm.grams(raw, lm.DEPTH)].sum(dtype=float)), rel_tol=1e-6)
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / (len(raw) + 1))
    bits = [r.bits_per_byte for r in rows if r.held_out]
    assert np.mean(bits) < 4


def test_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT", 4)
    docs = [(k, " ".join(f"w{(k * j) % 13}" for j in range(k + 1))) for k in range(40)] + [(3, "w0 w1"), (3, "w0 w1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    counts = Counter()
    for k, t in docs:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update([*t.split(), None])
    n, v = sum(counts.values()), len(counts)
    found = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 8)) for r in lm.score(df).collect())
    plain = sorted((k, len(t.split()) + 1, sum(counts[w] > 0 for w in [*t.split(), None]), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*t.split(), None]), 8)) for k, t in docs)
    assert found == plain


def test_a_long_text_is_scored_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK", 64)
    text = data.prose(400, 9)
    df = spark.createDataFrame([(k, text) for k in range(12)], "doc_id long, text string")
    scores = {round(r.score, 3) for r in lm.score(df).collect()}
    monkeypatch.undo()
    assert scores == {round(r.score, 3) for r in lm.score(df).collect()} and len(scores) == 1


def test_odd_inputs(spark):
    rows = lm.score(data.odd(spark)).collect()
    assert len(rows) == len(data.odd_rows())
    assert sum(r.n_tokens == 1 for r in rows) == 3 and max(r.n_tokens for r in rows) == 40_001
    assert lm.score(data.empty(spark)).count() == 0
    only_held = spark.createDataFrame([(k, "abc") for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 1], "doc_id long, text string")
    for r in lm.score(only_held).collect():
        assert r.train_tokens == 0 and math.isclose(r.bits_per_byte, 8, rel_tol=1e-6) and r.n_known == 0


def test_long_contexts_leave_a_trace_and_distributed_codes_equal_recursion(spark, monkeypatch):
    monkeypatch.setattr(lm, "HOT_GRAMS", 8)  # most codes are joined
    monkeypatch.setattr(lm, "TREE_ROWS", 50)
    draw = random.Random(4)
    # After "qrst" comes what stood five bytes before it: shorter contexts cannot tell.
    docs = [(k, " ".join(f"{c}qrst{c}" for c in (draw.choice("ab") for _ in range(30)))) for k in range(40)] + [(41, "zz new"), (3, "a"), (3, "a")]
    counts = Counter()
    for k, t in docs:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(lm.grams(lm.lowered(t), lm.DEPTH).tolist())
    assert lm.DEPTH >= 5
    tree = Tree(counts, lm.DEPTH)
    known = {}

    def code(gram):
        if gram not in known:
            known[gram] = tree.log10(gram)
        return known[gram]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = sorted((r.doc_id, r.score) for r in lm.score(df).collect())
    plain = sorted((k, sum(map(code, lm.grams(lm.lowered(t), lm.DEPTH).tolist()))) for k, t in docs)
    assert [k for k, _ in found] == [k for k, _ in plain] and np.allclose([s for _, s in found], [s for _, s in plain], rtol=1e-9)
    long = [s for (k, s), (_, t) in zip(plain, sorted(docs)) if len(t) > 20]
    two = Tree(Counter({g: n for g, n in _shortened(counts, 2).items()}), 2)
    assert np.mean(long) > 1.5 * np.mean([sum(two.log10(g) for g in lm.grams(lm.lowered(docs[0][1]), 2).tolist())])


def _shortened(counts, depth):
    out = Counter()
    for gram, n in counts.items():
        out[gram & ((1 << 8 * (depth + 1)) - 1)] += n
    return out


def test_words_take_one_pass(spark):
    """Figures and rare words of a text come from one pass over the texts, the bytes in context from another; keys of any type."""
    df = spark.createDataFrame([("a", "one two two"), ("a", "one two two"), (None, "x"), ("b", None)], "doc_id string, text string")
    scored = lm.score(df)
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    assert sorted((r.doc_id or "", r.n_tokens) for r in scored.collect()) == [("", 2), ("a", 4), ("a", 4), ("b", 1)]
