"""Language detection from function words, as one expression per text.

The score of a language is the weighted number of tokens found in its profile.
Scores are integers, so the result is exact and the same everywhere. There is
no shuffle: the profile is small and travels in the plan as literal sets.
Profiles too large for that are joined, see ``operators.languages``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.lambdas import filter_items, literal, literals, map_value

UNKNOWN = "error"
Profile = Mapping[str, Sequence[str]]


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def detect_language(text: Column, profile: Profile = fixed.LANGUAGE_WORDS) -> Column:
    """Best language of a text, ties by name; ``error`` if no token is known."""
    vocabulary = sorted({w for words in profile.values() for w in words})
    known = filter_items(word_tokens(text), f"w in ({literals(vocabulary)})")
    # The smallest (rank, name) wins: -2 * hits per language, and -1 for
    # "error", which therefore loses to a single hit and beats none.
    candidates = [
        f"struct(-2 * size(filter(w, t -> t in ({literals(profile[name])}))) as rank,"
        f" {literal(name)} as lang)"
        for name in sorted(profile)
    ]
    nothing = f"struct(-1 as rank, {literal(UNKNOWN)} as lang)"
    best = map_value(known, f"array_min(array({', '.join(candidates)}, {nothing})).lang")
    return F.when(text.isNull(), F.lit(UNKNOWN)).otherwise(best)
