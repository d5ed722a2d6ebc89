import random

import pytest
from tokenizers import Tokenizer

from labelloom.llm import bpe, pieces
from tests.llm import data

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load(PATH))


@pytest.fixture(scope="module")
def tokenizer():
    out = Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


def test_codec_equals_library(codec, tokenizer):
    draw = random.Random(3)
    letters = "abcdeéß \n\t<|>0123 日本🎉'sTHEing\x1c \x85½²"
    for k in range(2000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        if k % 5 == 0:
            text = text[:10] + "<|endoftext|>" + text[10:]
        if k % 7 == 0:
            text = draw.choice(["a", "the", "=", " ", "\n", "é"]) * draw.randint(1, 200) + text
        ids = codec.ids(text)
        expected = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == expected
        assert codec.text(ids) == tokenizer.decode(expected, skip_special_tokens=False) == text


def test_work_on_a_long_piece_is_linear(codec, tokenizer):
    text = "ab" * 50_000
    assert codec.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_broken_bytes_are_replaced(codec):
    first = codec.ids("é")
    assert len(first) == 1 or codec.text(first[:1]) != ""
    euro = [i for i, t in ((i, t) for t, i in codec.tokens.items()) if t == b"\xe2"]
    assert codec.text(euro) == "�"


def test_query_equals_library(spark, sf_dir, tokenizer):
    rows = {r.doc_id: r for r in bpe.op6_bpe(spark, sf_dir).collect()}
    texts = data.texts(spark, sf_dir)
    assert set(rows) == set(texts)
    for key, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        row = rows[key]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), data.sha(",".join(map(str, ids))))
        assert row.decoded_sha256 == data.sha(tokenizer.decode(ids, skip_special_tokens=False))


def test_odd_inputs(spark):
    rows = bpe.encode_decode(data.odd(spark), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == sorted((r[0] or 0, r[1] or "") for r in data.odd_rows())
    assert bpe.encode_decode(data.empty(spark), PATH).count() == 0
    assert [r.ids for r in bpe.encode(data.odd(spark), PATH).collect()] == [r.ids for r in rows]


# --- token counts --------------------------------------------------------------------


def greedy(word: bytes, first: set, later: set) -> int:
    """Plain longest match; 0 if it fails."""
    count, at, vocabulary = 0, 0, first
    started = False
    while at < len(word) or not started:
        end = next((e for e in range(len(word), at - (not started), -1) if word[at:e] in vocabulary and (e > at or not started)), None)
        if end is None:
            return 0
        count, at, vocabulary, started = count + 1, end, later, True
    return count


@pytest.mark.parametrize("seed", range(6))
def test_automaton_equals_greedy(seed):
    draw = random.Random(seed)
    some = lambda n: {bytes(draw.choice(b"abc") for _ in range(draw.randint(1, 4))) for _ in range(n)}
    first, later = some(9), some(7)
    if seed % 2:
        first.add(b"")
    automaton = pieces.Automaton(first, later)
    for _ in range(500):
        word = bytes(draw.choice(b"abcd" if draw.random() < 0.1 else b"abc") for _ in range(draw.randint(1, 12)))
        assert automaton.count(word) == greedy(word, first, later), (word, first, later)


def test_counts_of_documents(spark, sf_dir):
    first, later = pieces.byte_vocabulary(PATH)
    for r in pieces.op9_token_counts(spark, sf_dir).filter("doc_id % 20 = 0").join(data.table(spark, sf_dir, "documents"), "doc_id").collect():
        each = [greedy(w, first, later) for w in r.text.encode().split()]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(each), sum(each) + each.count(0), each.count(0))


def test_unknown_words_count_as_one(spark):
    df = spark.createDataFrame([(1, "ab zz ab"), (2, None), (2, "")], "doc_id long, text string")
    rows = pieces.token_counts(df, ({b"a"}, {b"b"}), "tiny").collect()
    assert [tuple(r) for r in rows] == [(1, 3, 5, 1, 2), (2, 0, 0, 0, 0), (2, 0, 0, 0, 0)]


def test_odd_inputs_of_counts(spark):
    vocabulary = pieces.byte_vocabulary(PATH)
    rows = pieces.token_counts(data.odd(spark), vocabulary, PATH).collect()
    assert len(rows) == len(data.odd_rows()) and sum(r.n_words == 0 for r in rows) == 3
    assert max(r.n_words for r in rows) == 40_000
    assert pieces.token_counts(data.empty(spark), vocabulary, PATH).count() == 0
