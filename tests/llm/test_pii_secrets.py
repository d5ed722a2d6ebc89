import random
import re

import pytest

from labelloom.llm import pii, secrets
from tests.llm import data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    each = [int(c) for c in digits][::-1]
    return (sum(each[::2]) + sum(sum(divmod(2 * d, 10)) for d in each[1::2])) % 10 == 0


def plain_personal(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


@pytest.fixture(scope="module")
def field():
    return pii.fitted()


def test_base_equals_patterns():
    draw = random.Random(2)
    for alphabet in ("ab@.1 2-+(", "0123456789 -", "+()0123456789 .", "é@a.b\n1"):
        for _ in range(4000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randint(0, 45)))
            assert sorted(pii.base_spans(text)) == plain_personal(text), text
    assert pii.base_spans("1" * 200_000 + "." + "0" * 100_000) == []


def test_field_generalises(field):
    fresh = pii.examples_of(pii.labelled_table(copies=3, seed=99))
    found = field.decode([x for x, _ in fresh])
    assert sum((p == y).all() for p, (_, y) in zip(found, fresh)) / len(fresh) > 0.97


@pytest.mark.parametrize(
    "text, spans",
    [
        ("Call (415) 555-2671 now", ["phone:5:19"]),
        ("on 2023-04-05 we paid 1200", []),
        ("the 3rd of 4 in 1999.", []),
        ("mail a.b@example.com, card 4111111111111111", ["email:5:20", "card:27:43"]),
    ],
)
def test_field_adds_what_the_patterns_miss(field, text, spans):
    base, more = pii.all_spans(text, field)
    assert pii.joined_spans([*base, *more], pii.KINDS) == ",".join(spans)


def test_viterbi_equals_all_labellings(field):
    import itertools

    import numpy as np

    features = pii.run_features("call", ["(415)", "555-2671"], "now")
    scores, move = field.scores(features), field.move + pii._allowed()
    best = max(itertools.product(range(pii.N_LABELS), repeat=2), key=lambda y: move[pii.N_LABELS, y[0]] + scores[0, y[0]] + move[y[0], y[1]] + scores[1, y[1]])
    assert tuple(np.array(field.decode([features])[0])) == best


def test_pii_query(spark, sf_dir):
    texts = data.texts(spark, sf_dir)
    rows = pii.op2_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_personal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in base) for i in range(4)]
        spans = pii.joined_spans(base, pii.KINDS)
        assert r.base_sha256 == data.sha(spans)
        assert set(filter(None, spans.split(","))) <= set(r.spans.split(","))


def test_odd_inputs_of_pii(spark, field):
    rows = pii.find_personal(data.odd(spark), field).collect()
    assert len(rows) == len(data.odd_rows()) and all(r.spans == "" for r in rows)
    assert pii.find_personal(data.empty(spark), field).count() == 0
    masked = pii.mask_personal(data.odd(spark), field)
    assert masked.columns == data.odd(spark).columns
    assert sorted(map(str, masked.collect())) == sorted(map(str, data.odd(spark).collect()))


def test_masking(spark, field):
    df = spark.createDataFrame([(1, "to a.b@example.com from 10.0.0.1 or (415) 555-2671!"), (2, None)], "doc_id long, text string")
    assert [r.text for r in pii.mask_personal(df, field).collect()] == ["to [email] from [ip] or [phone]!", None]


# --- secrets -------------------------------------------------------------------------

ASSIGN = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_secrets(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out)


def test_base_secrets_equal_patterns():
    draw = random.Random(4)
    parts = ["password", "PassWd", "token", "api_key", "APIKEY", "ſecret", "toKen", "=", ":", " ", '"', "'", "abcdefgh", "A1", "AKIA", "0123456789abcdef", "é", "\n"]
    for _ in range(6000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert sorted(secrets.base_spans(text)) == plain_secrets(text), text


@pytest.mark.parametrize(
    "text, found",
    [
        ('const K = "Zx81kPq0LLmn"; auth_token = K', ["Zx81kPq0LLmn"]),
        ('a = "Zx81kPq0LLmn"\nb = a\nclient_secret_value = 1\ndb_pwd = b', ["Zx81kPq0LLmn"]),
        ("<passphrase>Tr0ub4dor&3x</passphrase>", ["Tr0ub4dor&3x"]),
        ('set("private_key", "Qm9vZ2llV29vZ2ll")', ["Qm9vZ2llV29vZ2ll"]),
        ('x = y\ny = x\nauth_token = x', []),
        ("token_count: 1234567890ab", []),
        ('pwd = "your_password_here"', []),
        ("The plan = something wonderful", []),
    ],
)
def test_literals(text, found):
    assert [text[s:e] for s, k, e in secrets.literal_spans(text)] == found


def test_secrets_query(spark, sf_dir):
    texts = data.texts(spark, sf_dir)
    rows = secrets.op10_secrets(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_secrets(texts[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert r.base_sha256 == data.sha(pii.joined_spans(base, secrets.KINDS))


def test_odd_inputs_of_secrets(spark):
    rows = secrets.find_secrets(data.odd(spark)).collect()
    assert len(rows) == len(data.odd_rows()) and all(r.spans == "" for r in rows)
    assert secrets.find_secrets(data.empty(spark)).count() == 0
    long = 'k = "a" ' * 20_000
    assert secrets.scan(long)[3] == ""
