import random

import numpy as np
import pytest
import sentencepiece

from labelloom.llm import merges
from labelloom.llm.bpe import vocabulary_path
from tests.llm import data

PATH = vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return merges.Codec(merges.read_pieces(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_model_file(library):
    found = merges.read_pieces(PATH)
    assert len(found.pieces) == library.vocab_size()
    for i, (piece, score, kind) in enumerate(found.pieces):
        assert (piece, score) == (library.id_to_piece(i), library.get_score(i))
        assert (kind == merges.BYTE, kind == merges.CONTROL, kind == merges.UNKNOWN) == (library.is_byte(i), library.is_control(i), library.is_unknown(i))


def test_codec_equals_library(codec, library):
    draw = random.Random(3)
    letters = "abcdeéß \n\t<|>0123 日本🎉'sTHEing\x1c \x85½²▁　\x00"
    for k in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
        if k % 5 == 0:
            text = text[:10] + draw.choice(["<s>", "</s>", "<unk>", "<0x0A>", "▁" * 3]) + text[10:]
        if k % 7 == 0:
            text = draw.choice(["a", "the", "=", " ", "\n", "é", "ab"]) * draw.randint(1, 200) + text
        expected = library.encode(text)
        ids = codec.ids(text)
        assert ids.tolist() == expected, text
        assert codec.text(ids) == library.decode(expected)


def test_decoding_of_any_ids(codec, library):
    draw = random.Random(4)
    for _ in range(2000):
        ids = [draw.choice([draw.randrange(32000), draw.randrange(3, 259), 1, 2, 0, 28705]) for _ in range(draw.randint(0, 8))]
        assert codec.text(np.array(ids, int)) == library.decode(ids), ids


def test_long_run_without_blanks(codec, library):
    for text in ("ab" * 20_000, " " * 30_001, "=" * 30_001, "x" + " " * 1000 + "\n" * 999):
        assert codec.ids(text).tolist() == library.encode(text)


def plain_merges(run: str, score: dict) -> list[str]:
    """Merge the best pair of all, again and again."""
    out = list(run)
    while True:
        best = min(((-score[a + b], i) for i, (a, b) in enumerate(zip(out, out[1:])) if a + b in score), default=None)
        if best is None:
            return out
        i = best[1]
        out[i : i + 2] = [out[i] + out[i + 1]]


@pytest.mark.parametrize("seed", range(8))
def test_agenda_equals_plain_merges(seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("ab▁") for _ in range(draw.randint(2, 4))) for _ in range(12)}
    pieces = [("<unk>", 0.0, merges.UNKNOWN)] + [(w, float(-draw.randint(0, 3)), merges.NORMAL) for w in sorted(words)]
    codec = merges.Codec(merges.Pieces(pieces))
    for _ in range(300):
        run = "".join(draw.choice("abc▁") for _ in range(draw.randint(0, 14)))
        expected = plain_merges(run, {w: s for w, s, kind in pieces if kind == merges.NORMAL})
        assert codec.merged(run) == expected
        longer = run * 4
        assert codec.merged(longer) == plain_merges(longer, {w: s for w, s, kind in pieces if kind == merges.NORMAL})
        ids = [codec.known.get(piece, 0) for piece in expected]
        assert not run or np.frombuffer(codec._chain_ids(run), np.int32).tolist() == ids


def test_user_symbols_unknowns_and_squeezed_blanks():
    pieces = [("<unk>", 0.0, merges.UNKNOWN), ("<x>", 0.0, merges.USER), ("a", -1.0, merges.NORMAL), ("▁", -2.0, merges.NORMAL), ("▁a", -3.0, merges.NORMAL)]
    codec = merges.Codec(merges.Pieces(pieces))
    assert codec.ids("  a<x>a  zz a ").tolist() == [4, 1, 2, 3, 0, 4]
    assert codec.text(codec.ids(" a<x>a  zz")) == "a<x>a  ⁇ "


def test_query_equals_library(spark, sf_dir, library):
    rows = {r.doc_id: r for r in merges.op12_pieces(spark, sf_dir).collect()}
    texts = data.texts(spark, sf_dir)
    assert set(rows) == set(texts)
    for key, text in texts.items():
        ids = library.encode(text)
        row = rows[key]
        assert row.agrees and (row.n_tokens, row.ids_sha256) == (len(ids), data.sha(",".join(map(str, ids))))
        assert row.decoded_sha256 == data.sha(library.decode(ids))


@pytest.mark.parametrize("check", ["texts", "runs"])
def test_check_against_the_library(codec, check):
    held = merges.Checked(merges.Codec(merges.read_pieces(PATH)), check)
    for text in ("some words", "", " ", "a ", "  two  marks ▁ ▁▁", "\n\t", "x" * 100 + " y", "é日本"):
        assert held(text)[2] is True
    # A codec that is wrong about one word is found out, and only in the texts that hold it.
    held.own.cache["▁words"] = held.own.cache["▁some"] = codec.run_ids("▁nothing")
    if check == "texts":
        assert held("some more words")[2] is False and held("other")[2] is True
    else:
        held.own.cache.clear()
        held.own.merged = lambda part: list(part) if part in ("▁words", "▁some") else merges.Codec.merged(held.own, part)
        assert held("other some words here")[2] is False and held.wrong == {"▁some", "▁words"}
        assert held("some more")[2] is False and held("other here")[2] is True


def test_check_is_an_option(spark):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    assert [merges.encode_decode(df, PATH, check=c).first().agrees for c in ("texts", "runs", None)] == [True, True, None]
    with pytest.raises(ValueError):
        merges.Checked(None, "some")


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(bytes([0x12, 0x02, 0x18, 0x01]))
    with pytest.raises(ValueError, match="merge-type"):
        merges.read_pieces(str(path))


def test_odd_inputs(spark):
    rows = merges.encode_decode(data.odd(spark), PATH).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in rows) == sorted((r[0] or 0, r[1] or "") for r in data.odd_rows())
    assert all(r.agrees for r in rows)
    assert merges.encode_decode(data.empty(spark), PATH).count() == 0
    assert merges.encode(data.empty(spark), PATH).count() == 0
    assert [r.ids for r in merges.encode(data.odd(spark), PATH).collect()] == [r.ids for r in rows]
