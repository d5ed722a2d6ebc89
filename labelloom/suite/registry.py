"""Registry of queries and small helpers to write their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from labelloom import fixed
from labelloom.functions import text as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- SQL spellings of the text functions ---------------------------------------

# The blanks of ``functions.text`` in RE2 syntax.
BLANKS = T.BLANKS
for _code in ("1680", "2000", "200a", "2028", "2029", "202f", "205f", "3000"):
    BLANKS = BLANKS.replace("\\u" + _code, "\\x{" + _code + "}")
_QUOTES = "«»“”„‘’"


def sql_strip_html(expression: str) -> str:
    return f"regexp_replace({expression}, '<.*?>', '', 'g')"


def sql_strip_urls(expression: str) -> str:
    return f"regexp_replace({expression}, 'https?://[^{BLANKS}]+|www\\.[^{BLANKS}]+', '', 'g')"


def sql_strip_digits(expression: str) -> str:
    return f"regexp_replace({expression}, '\\p{{Nd}}+', '', 'g')"


def sql_before_tokens(expression: str) -> str:
    return sql_strip_digits(sql_strip_urls(sql_strip_html(f"lower({expression})")))


def sql_tokens(expression: str, abbreviations: str | None = None) -> str:
    """Words of digit-free text: whitespace tokens, each reduced to its letters.

    ``abbreviations`` is a list expression that takes the place of the fixed list.
    """
    spaced = (
        f"regexp_replace({expression},"
        f" '[;@#$%&?!*\\[\\](){{}}<>\"`{_QUOTES}:,{BLANKS}]|\\.{{2,}}|--|''''', ' ', 'g')"
    )
    raw = f"list_filter(string_split({spaced}, ' '), lambda w: w <> '')"
    stopped = "|".join(["\\p{L}", *(() if abbreviations else fixed.ABBREVIATIONS)])
    learned = f" or list_contains({abbreviations}, w[:-2]) and w like '%.'" if abbreviations else ""
    # An abbreviation keeps its full stop unless it ends the text.
    # A one-element list names the token list, so that it is made once per text.
    words = (
        f"list_transform([{raw}], lambda r: list_transform(r, lambda w, i: case"
        f" when i < len(r) and (regexp_matches(w, '^(?:{stopped})\\.$'){learned}) then ''"
        f" else regexp_extract(w, '^(\\p{{L}}+?)(?:n''t|''(?:s|m|d|ll|re|ve)?)?\\.?''*$', 1) end))[1]"
    )
    fused = (
        f"flatten(list_transform({words}, lambda w: case w when 'cannot' then ['can', 'not']"
        " when 'gimme' then ['gim', 'me'] when 'lemme' then ['lem', 'me']"
        " when 'gonna' then ['gon', 'na'] when 'wanna' then ['wan', 'na']"
        " when 'gotta' then ['got', 'ta'] else [w] end))"
    )
    return f"list_filter({fused}, lambda w: w <> '')"


def sql_without_stop_words(tokens: str) -> str:
    return f"list_filter({tokens}, lambda w: w not in ({quoted(fixed.REMOVED_STOP_WORDS)}))"


def sql_lemma(word: str) -> str:
    irregular = " ".join(
        f"when '{plural}' then '{lemma}'" for plural, lemma in fixed.LEMMA_IRREGULAR.items()
    )

    def cut(n: int) -> str:
        return f"{word}[:-{n + 1}]"

    return (
        f"case when {word} in ({quoted(fixed.LEMMA_IRREGULAR)}) then case {word} {irregular} end"
        f" when {word} in ({quoted(fixed.LEMMA_UNCHANGED)}) then {word}"
        f" when {word} like '%men' then {cut(2)} || 'an'"
        f" when {word} not like '%s' then {word}"
        f" when regexp_matches({word}, '(ss|us|is)$') then {word}"
        f" when {word} like '%ies' and len({word}) > 4 then {cut(3)} || 'y'"
        f" when regexp_matches({word}, '(sses|ches|shes|xes|oes)$') then {cut(2)}"
        f" when {word} like '%uses' and {word} not like '%auses' and {word} not like '%ouses'"
        f" then {cut(2)}"
        f" else {cut(1)} end"
    )


def sql_process_text(expression: str) -> str:
    kept = sql_without_stop_words(sql_tokens(sql_before_tokens(expression)))
    return f"array_to_string(list_transform({kept}, lambda w: {sql_lemma('w')}), ' ')"


def sql_contains_any(expression: str, markers: Iterable[str]) -> str:
    return "(" + " or ".join(f"contains({expression}, {quoted([m])})" for m in markers) + ")"


def sql_word_tokens(expression: str) -> str:
    return f"regexp_extract_all(lower({expression}), '\\p{{L}}+')"


def sql_language(source: str, row_id: str, text: str) -> str:
    """(row id, language) by function words, as a sub-query."""
    entries = ", ".join(
        f"('{lang}', '{word}')" for lang in sorted(fixed.LANGUAGE_WORDS) for word in fixed.LANGUAGE_WORDS[lang]
    )
    return f"""(
      with tokens as (select {source}.{row_id} as rid, unnest({sql_word_tokens(text)}) as token from {source}),
      hits as (
        select rid, lang, count(*) as score
        from tokens join (values {entries}) p(lang, word) on token = word group by 1, 2),
      best as (
        select rid, lang, row_number() over (partition by rid order by score desc, lang) as rn from hits)
      select s.{row_id}, coalesce(b.lang, 'error') as language
      from {source} s left join best b on s.{row_id} = b.rid and rn = 1)"""


# --- SQL spellings of random keys ------------------------------------------------


def sql_key(seed: str | int, *columns: str) -> str:
    seed = f"'{seed}'" if not str(seed).startswith("(") else f"cast({seed} as varchar)"
    casts = ", ".join(f"cast({c} as varchar)" for c in columns)
    return f"md5(concat_ws('|', {seed}, {casts}))"


def sql_random(seed: str | int, *columns: str) -> str:
    return f"cast('0x' || substr({sql_key(seed, *columns)}, 1, 8) as bigint)"
