"""Text cleaning as Spark column expressions.

Each function maps a column to a column and stays inside the JVM. Patterns
are written for Java's regular expressions but give the results of Unicode
aware patterns: blanks and decimal digits of every script count, and "." stops
at a line feed only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions.lambdas import (
    filter_items,
    literal,
    literals,
    map_items,
    map_value,
)

BLANKS = fixed.BLANKS

# Characters and pairs that are always tokens of their own, and the blanks
# other than a space. No word token holds them, so a space in their place gives
# the same words.
SEPARATOR = (
    r"(?![\p{L} ])(?:[;@#$%&?!*\[\](){}<>\"`«»“”„‘’" + BLANKS.replace(r"\s", r"\t\n\x0B\f\r")
    + r"]|[:,](?!\p{Nd})|\.{2,}|--|'')"
)

_WORD_CHAR = r"[\p{L}\p{N}_]"
# Two words written as one: a space goes between them.
FUSED_WORD = (
    rf"(?=[cglw])(?<!{_WORD_CHAR})(?:can(?=not(?!{_WORD_CHAR}))|(?:gim|lem)(?=me(?!{_WORD_CHAR}))"
    rf"|gon(?=na(?!{_WORD_CHAR}))|wan(?=na )|got(?=ta(?!{_WORD_CHAR})))"
)


def _word_pattern(abbreviations: Sequence[str]) -> str:
    """A run of letters that fills a token, less its contraction and full stop."""
    end = r"\.?'*+(?: |\z)"
    kept_stop = "|".join([r"\p{L}", *abbreviations])
    return (
        r"(?<![^ ])(?:\p{L}++(?:(?= |\z)"
        rf"|(?!(?<=(?<![^ ])(?:{kept_stop}))\. +[^ ])(?=(?:'(?:s|m|d|ll|re|ve)?)?{end}))"
        rf"|\p{{L}}+(?=n't{end}))"
    )


def strip_html(text: Column) -> Column:
    """Remove tags; a tag ends at the first ">" on its line."""
    return F.regexp_replace(text, fixed.TAG, "")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, fixed.URL, "")


def strip_html_and_urls(text: Column) -> Column:
    return strip_urls(strip_html(text))


def strip_digits(text: Column) -> Column:
    return F.regexp_replace(text, fixed.DIGITS, "")


def strip_blanks(text: Column) -> Column:
    """Trim every kind of Unicode blank from both ends."""
    return F.regexp_replace(text, rf"^[{BLANKS}]+|[{BLANKS}]+\z", "")


def strip_numbered_lists(text: Column) -> Column:
    return F.regexp_replace(text, fixed.LIST_MARKER, "")


def _spaced(text: Column) -> Column:
    """Text with blanks in the place of separators and between words written as one."""
    return F.regexp_replace(F.regexp_replace(text, SEPARATOR, " "), FUSED_WORD, "$0 ")


def stopped_words(text: Column) -> Column:
    """Distinct words of letters that have a full stop behind them and are not the last token."""
    tokens = filter_items(F.split(_spaced(text), " +"), "w <> ''")
    before = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))
    return F.array_distinct(map_items(filter_items(before, r"w rlike '^\\p{L}+\\.$'"), "left(w, length(w) - 1)"))


def _without(spaced: Column, is_abbreviation: Callable[[Column], Column]) -> Column:
    """Text without the abbreviations, which are no words; the last token ends the text and stays."""

    def keep(tokens: Column) -> Column:
        inside = lambda w, i: (i < F.size(tokens) - 1) & w.endswith(".") & is_abbreviation(F.left(w, F.length(w) - 1))
        return F.array_join(F.filter(tokens, lambda w, i: ~inside(w, i)), " ")

    # The tokens are named twice; an array of one keeps them computed once.
    tokens = filter_items(F.split(spaced, " +"), "w <> ''")
    return F.get(F.transform(F.array(tokens), keep), F.lit(0))


def alpha_tokens(
    text: Column, abbreviations: Sequence[str] | Column = fixed.ABBREVIATIONS
) -> Column:
    """Array of the purely alphabetic word tokens of lower-case text.

    Punctuation is split off and contractions are split ("don't" leaves "do");
    hyphenated and dotted tokens such as "state-of-the-art" or "e.g." are
    dropped whole. A full stop is split off wherever it ends a sentence, that
    is, unless it follows an abbreviation or a single letter inside the text.

    ``abbreviations``: a list, or an array column with those of the row. A learned list
    may be long, see ``operators.sentences``; only the default list is part of the pattern.
    """
    spaced = _spaced(text)
    if abbreviations is not fixed.ABBREVIATIONS:
        if isinstance(abbreviations, Column):
            known = lambda w: F.array_contains(abbreviations, w)
        else:
            known = lambda w: w.isin(*abbreviations) if abbreviations else F.lit(False)
        spaced, abbreviations = _without(spaced, known), ()
    return F.regexp_extract_all(spaced, F.lit(_word_pattern(abbreviations)), F.lit(0))


def remove_stop_words(
    tokens: Column, stop_words: Iterable[str] = fixed.REMOVED_STOP_WORDS
) -> Column:
    words = literals(stop_words)
    return filter_items(tokens, f"w not in ({words})") if words else tokens


def _lemma_rules() -> str:
    """Suffix rules and word lists as one SQL case over the word ``w``."""
    irregular = " ".join(
        f"when {literal(plural)} then {literal(lemma)}"
        for plural, lemma in fixed.LEMMA_IRREGULAR.items()
    )

    def ends(*suffixes: str) -> str:
        return "(" + " or ".join(f"endswith(w, '{s}')" for s in suffixes) + ")"

    def less(chars: int) -> str:
        return f"left(w, length(w) - {chars})"

    # Only words on the list or ending in "s" or "men" can change.
    return f"""case
        when w in ({literals(fixed.LEMMA_IRREGULAR)}) then case w {irregular} end
        when not {ends("s", "men")} or w in ({literals(fixed.LEMMA_UNCHANGED)}) then w
        when {ends("men")} then concat({less(2)}, 'an')
        when {ends("ss", "us", "is")} then w
        when {ends("ies")} and length(w) > 4 then concat({less(3)}, 'y')
        when {ends("sses", "ches", "shes", "xes", "oes")} then {less(2)}
        when {ends("uses")} and not {ends("auses", "ouses")} then {less(2)}
        else {less(1)} end"""


def lemmatize_tokens(tokens: Column) -> Column:
    """Singular forms of lower-case nouns by suffix rules and short word lists.

    An approximation: the full rules ask a dictionary which candidate is a
    word. ``operators.vocabulary`` applies them against a vocabulary table.
    """
    return map_items(tokens, _lemma_rules())


def lemmatize_noun(word: Column) -> Column:
    return map_value(word, _lemma_rules())


def clean_before_tokens(text: Column) -> Column:
    """Lower case, then without tags, URLs and digits."""
    return strip_digits(strip_html_and_urls(F.lower(text)))


def process_text(
    text: Column,
    stop_words: Iterable[str] = fixed.REMOVED_STOP_WORDS,
    abbreviations: Sequence[str] | Column = fixed.ABBREVIATIONS,
) -> Column:
    """Normalised text: cleaned, tokenised, stop words removed, lemmatised."""
    tokens = alpha_tokens(clean_before_tokens(text), abbreviations)
    tokens = lemmatize_tokens(remove_stop_words(tokens, stop_words))
    return F.array_join(tokens, " ")


def clean_synthetic_text(
    text: Column, markers: Sequence[str] = fixed.SYNTHETIC_MARKERS
) -> Column:
    """Keep what follows the last marker and blank of the first marker present."""
    result = text
    for marker in reversed(markers):
        result = F.when(
            F.contains(text, F.lit(marker)),
            F.substring_index(text, marker + " ", -1),
        ).otherwise(result)
    return result


def clean_model_output(text: Column, marker: str = fixed.ANSWER_MARKER) -> Column:
    """Tail after a single marker, restricted to plain letters and punctuation."""
    once = F.regexp_count(text, F.lit(rf"\Q{marker}\E")) == 1
    tail = F.when(once, F.substring_index(text, marker, -1)).otherwise(text)
    # A blank is no permitted character either, so one pattern both replaces
    # what is not permitted and collapses runs of blanks. The look-ahead only
    # rejects letters early.
    return F.trim(F.regexp_replace(tail, r"(?![A-Za-z])[^A-Za-z0-9(),.:!?\"']+", " "))


def contains_any(text: Column, markers: Sequence[str]) -> Column:
    """True where the text holds one of the markers as a substring."""
    found = F.lit(False)
    for marker in markers:
        found = found | F.contains(text, F.lit(marker))
    return found


def marker_flag(
    text: Column, markers: Sequence[str] = fixed.ABSTRACT_MARKERS
) -> Column:
    """1 where the lower-cased text holds a marker, else 0."""
    # One alternation, so that the text is lower-cased once and not per marker.
    pattern = "|".join(rf"\Q{marker}\E" for marker in markers)
    return F.coalesce(F.lower(text).rlike(pattern).cast("int"), F.lit(0))


def strip_id_prefix(value: Column, prefix: str | None = None) -> Column:
    """Remove the repository prefix ``oai:<host>:`` (or a given one) from an id."""
    if prefix is None:
        return F.regexp_replace(value, r"^oai:[^:]+:", "")
    return F.replace(value, F.lit(prefix), F.lit(""))


def split_lines(value: Column) -> Column:
    return F.split(value, "\n", -1)


def split_path(value: Column, separator: str = fixed.PATH_SEPARATOR) -> Column:
    return F.split(value, rf"\Q{separator}\E", -1)


def array_to_text(values: Column, separator: str = ";") -> Column:
    """Null stays null, an empty array gives an empty string."""
    return F.array_join(values, separator)


def truncate_tokens(tokens: Column, limit: int = fixed.MAX_TOKENS) -> Column:
    return F.slice(tokens, 1, limit)
