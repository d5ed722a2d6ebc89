import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from labelloom.llm import alignment, bpe, merges
from tests.llm import data

A, B = bpe.vocabulary_path(), bpe.vocabulary_path("piece_bpe_32k.model")


class Plain:
    """Groups and links by the two libraries, token by token."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        letters = {c: b for b, c in enumerate(bpe.byte_letters())}
        self.bytes_a = lambda i: bytes(letters[c] for c in self.a.id_to_token(i))

    def bytes_b(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def ranges(self, ids, of):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(of(i)), i))
            at = out[-1][1]
        return out

    def align(self, text):
        """(A ids, B ids, groups, links) or None."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.bytes_a, a)) != whole or b"".join(map(self.bytes_b, b)) != whole:
            return None
        ra, rb = self.ranges(a, self.bytes_a), self.ranges(b, self.bytes_b)
        cuts = sorted({e for _, e, _ in ra} & {e for _, e, _ in rb})
        group = {end: k for k, end in enumerate(cuts)}
        lists = [([], []) for _ in cuts]
        for kind, tokens in enumerate((ra, rb)):
            k = 0
            for _, end, i in tokens:
                lists[k][kind].append(str(i))
                k = group[end] + 1 if end in group else k
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in lists]
        # Which tokens own a byte: two tokens overlap if they own one together.
        owners = ([k for k, (s, e, _) in enumerate(r) for _ in range(s, e)] for r in (ra, rb))
        links = [(a[i], b[j]) for i, j in sorted(set(zip(*owners)))]
        return a, b, groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(bpe.load(A), merges.read_pieces(B))


def measured(rows, plain):
    """Measures of (key, text) rows by counting all pairs of all rows."""
    found = [(key, plain.align(text)) for key, text in rows]
    documents = Counter(pair for _, x in found if x for pair in set(x[3]))
    most = defaultdict(int)
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    out = []
    for key, x in found:
        if x is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = x
        best = sum(documents[p] == most[p[0]] for p in links)
        out.append((key, len(a), len(b), len(groups), len(links), best, sum(documents[p] for p in links), data.sha(";".join(groups))))
    return out


def listed(df, key="doc_id"):
    return sorted(
        ((r[key], r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()), key=str
    )


def test_texts_equal_libraries(aligner, plain):
    draw = random.Random(5)
    letters = ["the ", " a", "bc", "é", "ß", " ", "  ", "\n", "\t", "0", "12", "日本", "🎉", "'s", "don't", "<|endoftext|>", "<s>", "\x85", " ", "x" * 30, "▁", "half-way", "\x1c"]
    for _ in range(1500):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 14)))
        expected, found = plain.align(text), aligner.text(text)
        assert (expected is None) == (found is None), repr(text)
        if expected:
            a, b, groups, links = expected
            ids_a, ids_b, n_groups, found_links, group_a, group_b = found
            assert (ids_a.tolist(), ids_b.tolist(), n_groups) == (a, b, len(groups)), repr(text)
            assert aligner.groups(ids_a, ids_b, group_a, group_b).decode() == ";".join(groups)
            assert Counter(found_links.tolist()) == Counter(i << 32 | j for i, j in links)


def test_very_long_runs(aligner, plain):
    for text in ("ab" * 60_000, "x" + " " * 60_000 + "y", "\n" * 60_000):
        a = plain.a.encode(" " + text, add_special_tokens=False).ids
        assert aligner.ids_a(" " + text).tolist() == a
        found = aligner.text(text)
        assert found[1].tolist() == plain.b.encode(text)


def test_query_equals_plain_version(spark, sf_dir, plain):
    texts = data.texts(spark, sf_dir)
    assert listed(alignment.op13_alignment(spark, sf_dir)) == sorted(measured(list(texts.items()), plain), key=str)


@pytest.mark.parametrize("most", [0, 3, 40, 10**6])
def test_ways_of_counting_agree(spark, plain, most):
    draw = random.Random(9)
    rows = [(k, data.prose(draw.randint(0, 12), draw.randint(0, 9)) + draw.choice(["", ".", " don't", "\n\nend"])) for k in range(60)]
    rows += [(100 + k, rows[3][1]) for k in range(40)] + [(200, ""), (201, "with ▁ mark")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert listed(alignment.compare(df, A, B, most_looked_up=most)) == sorted(measured(rows, plain), key=str)


def test_groups_of_texts(spark):
    df = spark.createDataFrame([(1, "unbelievable tokenizers"), (2, None)], "key long, text string")
    rows = {r.key: r for r in alignment.align(df, A, B, keys=("key",), with_groups=True).collect()}
    assert data.sha(rows[1].groups) == rows[1].groups_sha256 and rows[1].groups.count(";") + 1 == rows[1].n_groups
    assert sum(rows[1].times) == rows[1].n_links and (rows[2].n_a, rows[2].pairs, rows[2].groups) == (0, [], "")


def test_looked_up_pairs_are_bounded(spark):
    rows = [(k, int(1.02**k) + k % 3) for k in range(1500)]
    counts = spark.createDataFrame(rows, "pair long, documents long")
    for most in (0, 1, 7, 100, 2000):
        found = sorted(r.documents for r in alignment.looked_up(counts, most).collect())
        assert len(found) <= most
        assert found == sorted(d for _, d in rows)[len(rows) - len(found) :]
    assert alignment.looked_up(counts, 2000).count() == 1500


def test_odd_inputs(spark, plain):
    rows = alignment.compare(data.odd(spark), A, B)
    assert rows.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    found = rows.collect()
    assert len(found) == len(data.odd_rows())
    assert sorted(r.n_a for r in found)[:2] == [0, 0] and all(r.groups_sha256 == "" for r in found if not r.n_a)
    long = next(r for r in found if r.doc_id == 4)
    assert long.n_groups > 40_000
    assert len({r for r in found if r.doc_id == 1}) == 1
    assert alignment.compare(data.empty(spark), A, B).count() == 0
