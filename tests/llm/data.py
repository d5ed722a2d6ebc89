"""Small inputs and plain versions of rules for the tests."""

from __future__ import annotations

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, key long, row long, words string, node long, host string, x double, n_tokens long, _kept string, _leaked long, _node string"

LONG = "lorem ipsum " * 20_000


def odd_rows():
    """Nulls, an empty and a very long text, repeated rows, and columns with names the operators use."""
    extra = ("t", 1, 2, "w", 3, "h", 0.5, 4, "k", 5, "n")
    return [
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45, *extra),
        (1, "Alpha beta gamma delta epsilon zeta eta theta", "en", "a", 45, *extra),
        (2, None, None, None, None, *extra),
        (3, "", "en", "a", 0, *extra),
        (None, "no key here", "en", "b", 11, *extra),
        (4, LONG, "en", "b", len(LONG), *extra),
        (5, " \t\n", "en", None, 3, *([None] * 11)),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(n: int, seed: int) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choice("bcdfgklmnprst") + draw.choice("aeiou") for _ in range(draw.randint(1, 4))) for _ in range(n)]


def prose(n: int, seed: int) -> str:
    return " ".join(words(n, seed))


def edited(text: str, changes: int, seed: int) -> str:
    draw, out = random.Random(seed), text.split()
    for at in draw.sample(range(len(out)), changes):
        out[at] = "changed" + str(draw.randint(0, 10**9))
    return " ".join(out)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
