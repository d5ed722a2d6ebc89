"""Text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions import labels, language
from labelloom.functions import text as T
from labelloom.operators import filters, languages, metrics, sentences, vocabulary
from labelloom.operators.sampling import bucket_split
from labelloom.sources.staging import stage
from labelloom.suite.registry import (
    query,
    quoted,
    sql_before_tokens,
    sql_contains_any,
    sql_language,
    sql_lemma,
    sql_process_text,
    sql_random,
    sql_strip_digits,
    sql_strip_html,
    sql_strip_urls,
    sql_tokens,
    sql_without_stop_words,
    sql_word_tokens,
    table,
)

FLAG_MARKERS = ("license", "@", "token =")
SYNTHETIC_TEST_MARKERS = ("license", "token")
REFUSAL_TEST_MARKERS = ("The ", "des ", "der ")


@query(f"select page_id, {sql_strip_html('lower(html)')} as text from pages")
def strip_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.strip_html(F.lower("html")).alias("text"))


@query(f"select page_id, {sql_strip_urls(sql_strip_html('lower(html)'))} as text from pages")
def strip_html_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.strip_html_and_urls(F.lower("html")).alias("text"))


@query(f"select doc_id, {sql_strip_digits('text')} as text from documents")
def strip_digits(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", T.strip_digits(F.col("text")).alias("text"))


@query(
    f"select doc_id, array_to_string({sql_tokens(sql_before_tokens('text'))}, ' ') as tokens from documents"
)
def alpha_tokens(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    tokens = T.alpha_tokens(T.clean_before_tokens(F.col("text")))
    return documents.select("doc_id", F.array_join(tokens, " ").alias("tokens"))


@query(
    "select page_id, array_to_string("
    + sql_without_stop_words(sql_tokens(sql_before_tokens("html")))
    + ", ' ') as tokens from pages"
)
def remove_stop_words(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    tokens = T.remove_stop_words(T.alpha_tokens(T.clean_before_tokens(F.col("html"))))
    return pages.select("page_id", F.array_join(tokens, " ").alias("tokens"))


@query(
    "with words as (select distinct unnest(" + sql_word_tokens("text") + ") as word from documents)"
    f" select word, {sql_lemma('word')} as lemma from words"
)
def lemmatize(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    words = vocabulary.distinct_tokens(
        documents.select(language.word_tokens(F.col("text")).alias("tokens")), "tokens"
    )
    return words.select(F.col("token").alias("word"), T.lemmatize_noun(F.col("token")).alias("lemma"))


#: Rounds of the suffix rules in the SQL below; no word of the tables needs more.
_ROUNDS = 12
_LEMMAS = (
    "words as (select distinct unnest(" + sql_word_tokens("text") + ") as token from documents), "
    "dictionary as (select distinct unnest(" + sql_word_tokens("text") + ") as word from benchmark), "
    "rules as (select * from (values "
    + ", ".join(f"({k + 1}, '{old}', '{new}')" for k, (old, new) in enumerate(vocabulary.NOUN_RULES))
    + ") r(rule, old, new)), irregular as (select * from (values "
    + ", ".join(f"({quoted([t])}, {quoted([w])})" for t, w in fixed.LEMMA_IRREGULAR.items())
    + ") i(token, lemma)), "
    "forms_0 as (select token, token as word, 0 as rule from words), "
    + ", ".join(
        f"forms_{n} as (select distinct token, word[:-(len(old) + 1)] || new as word, r.rule"
        f" from forms_{n - 1} f join rules r on ends_with(word, old))"
        for n in range(1, _ROUNDS + 1)
    )
    + ", forms as (select token, 1 as round, rule, word from forms_0 "
    + " ".join(f"union all select token, {n}, rule, word from forms_{n}" for n in range(1, _ROUNDS + 1))
    + " union all select token, 0, 0, token from words where token in (select token from irregular)"
    " union all select token, 0, 1, lemma from words join irregular using (token)), "
    "known as (select token, arg_min(word, (round, len(word), rule, word)) as lemma from forms"
    " where word in (select word from dictionary) group by token), "
    "lemmas as (select token, coalesce(lemma, token) as lemma from words left join known using (token))"
)


def _lemmas(spark, sf_dir):
    words = vocabulary.distinct_tokens(
        table(spark, sf_dir, "documents").select(language.word_tokens(F.col("text")).alias("tokens")),
        "tokens",
    )
    known = vocabulary.distinct_tokens(
        table(spark, sf_dir, "benchmark").select(language.word_tokens(F.col("text")).alias("tokens")),
        "tokens",
    )
    return vocabulary.lemma_table(words, known.withColumnRenamed("token", "word"), vocabulary.default_exceptions(words))


@query(f"with {_LEMMAS} select * from lemmas")
def lemma_table(spark, sf_dir):
    """Dictionary-tested lemmas; the words of one table serve as vocabulary."""
    return _lemmas(spark, sf_dir)


@query(
    f"""with {_LEMMAS}, placed as (select doc_id, unnest(tokens) as token, unnest(range(len(tokens))) as pos
      from (select doc_id, {sql_word_tokens('text')} as tokens from documents))
    select d.doc_id, coalesce(string_agg(lemma, ' ' order by pos), '') as text_clean
    from documents d left join placed p on p.doc_id = d.doc_id left join lemmas using (token) group by 1"""
)
def apply_lemmas(spark, sf_dir):
    """The words of every document under the dictionary."""
    rows = table(spark, sf_dir, "documents").select("doc_id", language.word_tokens(F.col("text")).alias("tokens"))
    return vocabulary.apply_lemmas(rows, _lemmas(spark, sf_dir), "doc_id", "tokens")


@query(f"select doc_id, {sql_process_text('text')} as text_clean from documents")
def process_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", T.process_text(F.col("text")).alias("text_clean"))


@query(f"select page_id, {sql_process_text('html')} as text_clean from pages")
def process_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.process_text(F.col("html")).alias("text_clean"))


def _sql_model_output(text: str) -> str:
    tail = (
        f"case when len(string_split({text}, 'Abstract')) = 2"
        f" then string_split({text}, 'Abstract')[2] else {text} end"
    )
    plain = f"regexp_replace({tail}, '[^A-Za-z0-9(),.:!?\"'']', ' ', 'g')"
    return f"trim(regexp_replace({plain}, '\\s{{2,}}', ' ', 'g'))"


@query(
    f"""select doc_id, {_sql_model_output('text')} as text from (select doc_id,
      case doc_id % 3 when 0 then 'Intro Abstract: ' || text when 1 then 'Abstract one Abstract ' || text
      else text end as text from documents)"""
)
def clean_model_output(spark, sf_dir):
    """One marker cuts the text, two or none leave it."""
    case = F.col("doc_id") % 3
    text = (
        F.when(case == 0, F.concat(F.lit("Intro Abstract: "), "text"))
        .when(case == 1, F.concat(F.lit("Abstract one Abstract "), "text"))
        .otherwise(F.col("text"))
    )
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", T.clean_model_output(text).alias("text"))


def _sql_synthetic(text: str, markers) -> str:
    cases = " ".join(
        f"when contains({text}, {quoted([m])}) then list_extract(string_split({text}, {quoted([m + ' '])}), -1)"
        for m in markers
    )
    return f"case {cases} else {text} end"


@query(f"select doc_id, {_sql_synthetic('text', SYNTHETIC_TEST_MARKERS)} as text from documents")
def clean_synth_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    cleaned = T.clean_synthetic_text(F.col("text"), SYNTHETIC_TEST_MARKERS)
    return documents.select("doc_id", cleaned.alias("text"))


@query(
    "select doc_id, regexp_replace('1. ' || text || chr(10) || '12.  end 3. x', '(?m)^\\p{Nd}+\\.\\s+', '', 'g') as text"
    " from documents"
)
def numbered_lists(spark, sf_dir):
    """Numbers go at the start of a line and stay within it."""
    documents = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("1. "), "text", F.lit("\n12.  end 3. x"))
    return documents.select("doc_id", T.strip_numbered_lists(text).alias("text"))


@query(
    f"select doc_id, cast({sql_contains_any('lower(text)', FLAG_MARKERS)} as integer) as is_abstract"
    " from documents"
)
def marker_flag(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", T.marker_flag(F.col("text"), FLAG_MARKERS).alias("is_abstract"))


@query(
    "select conv_id, turn, text from conversations where not "
    + sql_contains_any("text", REFUSAL_TEST_MARKERS)
)
def refusal_filter(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return filters.drop_refusals(conversations, "text", REFUSAL_TEST_MARKERS)


@query("select conv_id, turn from conversations where turn % 4 <> 0")
def default_refusals(spark, sf_dir):
    """Every fourth turn holds one of the library's own refusal markers."""
    turns = table(spark, sf_dir, "conversations")
    marker = F.element_at(F.array(*map(F.lit, fixed.REFUSAL_MARKERS)), (F.col("conv_id") % 3 + 1).cast("int"))
    text = F.when(F.col("turn") % 4 == 0, F.concat("text", F.lit(" "), marker)).otherwise(F.col("text"))
    return filters.drop_refusals(turns.withColumn("message", text)).select("conv_id", "turn")


@query("select doc_id, text from documents where lang = 'en' and doc_id % 7 <> 0")
def english_only(spark, sf_dir):
    """Every seventh text is missing."""
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    documents = table(spark, sf_dir, "documents").withColumn("text", text)
    english = filters.only_language(filters.drop_missing(documents), column="lang")
    return english.select("doc_id", "text")


@query(f"select * from {sql_language('documents', 'doc_id', 'text')}")
def detect_language(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", language.detect_language(F.col("text")).alias("language"))


@query(
    f"""with found as (select d.lang, l.language
      from documents d join {sql_language('documents', 'doc_id', 'text')} l using (doc_id)),
    classes as (select lang as class from found union select language from found),
    f as (
      select class,
        (select count(*) from found where lang = class) as support,
        (select count(*) from found where language = class) as predicted,
        (select count(*) from found where lang = class and language = class) as tp
      from classes)
    select round(sum(tp) / sum(support), 6) as accuracy,
      round(sum(support * 2 * tp / (support + predicted)) / sum(support), 6) as weighted_f1 from f"""
)
def detect_language_report(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    found = documents.select("lang", language.detect_language(F.col("text")).alias("language"))
    scores = metrics.report(found, "lang", "language")
    return scores.select(*[F.round(c, 6).alias(c) for c in scores.columns])


_LEARNED = f"""
    tokens as (select lang, unnest({sql_word_tokens('text')}) as token from documents),
    counts as (select lang, token, count(*) as n from tokens group by 1, 2),
    totals as (select lang, sum(n) as total from counts group by 1),
    profile as (select lang, token,
      cast((cast(n as hugeint) * {languages.PARTS} + cast(total as hugeint) - 1) // cast(total as hugeint) as bigint) as weight
      from counts join totals using (lang))"""


@query(f"with {_LEARNED} select * from profile")
def language_profiles(spark, sf_dir):
    return languages.learn_profiles(table(spark, sf_dir, "documents"))


@query(
    f"""with {_LEARNED},
    rows as (select conv_id || '-' || turn as row_id, text from conversations),
    words as (select row_id, unnest({sql_word_tokens('text')}) as token from rows),
    scores as (select row_id, lang, sum(weight) as score from words join profile using (token) group by 1, 2),
    best as (select row_id, lang, row_number() over (partition by row_id order by score desc, lang) as rn
      from scores)
    select rows.row_id, coalesce(lang, 'error') as language
    from rows left join best on rows.row_id = best.row_id and rn = 1"""
)
def detect_learned(spark, sf_dir):
    """Profiles learned from one table, applied to another by join."""
    profiles = stage(languages.learn_profiles(table(spark, sf_dir, "documents")), "profiles")
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("row_id"), "text"
    )
    return languages.detect_by_join(rows, profiles, "row_id")


# --- learned abbreviations ------------------------------------------------------------------


#: A fifth of the turns, told by a hash of the row, says "approx." and "i.e." in front of its text.
_SAID = "case when conv_id % 5 = 0 then 'Approx. ' || turn || ' i.e. ' || text else text end"
_ABBREVIATIONS = rf"""said as (select conv_id || '-' || turn as row_id, {_SAID} as text from conversations),
    types as (select unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+(?:\.[\p{{L}}\p{{N}}]+)*\.?')) as type from said),
    stops as (select rtrim(type, '.') as token, cast(sum(cast(type like '%.' as integer)) as bigint) as with_stop,
      cast(sum(cast(type not like '%.' as integer)) as bigint) as without_stop from types group by 1),
    share as (select least(sum(with_stop)::double / sum(with_stop + without_stop), 0.99) as p from stops),
    parts as (select *, len(token) - len(replace(token, '.', '')) as inner_stops, p from stops cross join share
      where with_stop > 0 and regexp_matches(token, '^\p{{L}}+(?:\.\p{{L}}+)*$')),
    scored as (select token, with_stop, without_stop, round(-2 * ((with_stop * ln(p) + without_stop * ln(1 - p))
        - (with_stop * ln(0.99::double) + without_stop * ln(1 - 0.99::double)))
      * exp(-(len(token) - inner_stops)) * (inner_stops + 1) * pow((len(token) - inner_stops)::double, -without_stop::double), 6) + 0.0::double as score
      from parts),
    learned as (select token, score from scored where score >= {sentences.LEAST_SCORE})"""


def _said(spark, sf_dir):
    text = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("Approx. "), "turn", F.lit(" i.e. "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), text.alias("text"))


@query(f"with {_ABBREVIATIONS} select * from scored")
def abbreviation_scores(spark, sf_dir):
    """How strongly each word holds on to its full stop."""
    return sentences.abbreviation_scores(_said(spark, sf_dir))


@query(f"with {_ABBREVIATIONS} select * from learned")
def learned_abbreviations(spark, sf_dir):
    return sentences.learn_abbreviations(_said(spark, sf_dir))


@query(
    f"""with {_ABBREVIATIONS}, listed as (select list(token) as known from learned)
    select row_id, array_to_string({sql_tokens(sql_before_tokens('text'), 'known')}, ' ') as tokens from said cross join listed"""
)
def learned_tokens(spark, sf_dir):
    """Sentence ends by the abbreviations that the same texts teach."""
    rows = _said(spark, sf_dir)
    found = sentences.tokens_with(rows, sentences.learn_abbreviations(rows), "row_id")
    return found.select("row_id", F.array_join("tokens", " ").alias("tokens"))


# --- open set of languages ---------------------------------------------------------------


def _sql_letters(source: str) -> str:
    """CTEs ``gains`` and ``known`` of the letter profiles of a table (lang, text)."""
    return f"""
    letter_words as (select lang, w, count(*) as n from (select lang, unnest({sql_word_tokens('text')}) as w from {source}) group by 1, 2),
    letter_counts as (select lang, gram, cast(sum(n) as bigint) as n from (select lang, n, unnest({_sql_runs('w')}) as gram
      from letter_words) group by 1, 2),
    gains as (select lang, gram, n, cast(round(ln(n + 1.0::double) * 1000) as bigint) as gain from letter_counts),
    known as (select lang, cast(round(ln(1.0::double / (sum(n) + (select count(distinct gram) from gains))) * 1000) as bigint) as unseen,
      sum(n * gain) // sum(n) as typical from gains group by 1)"""


def _sql_runs(word: str) -> str:
    return f"list_transform(range(1, len({word}) + 1), lambda i: substr(' ' || {word} || ' ', i, 3))"


def _sql_open_set(rows: str, row_id: str) -> str:
    """CTE ``found`` (row id, language) for a table with the row id and text."""
    return f"""
    row_words as (select {row_id}, unnest({sql_word_tokens('text')}) as w from {rows}),
    row_grams as (select {row_id}, unnest({_sql_runs('w')}) as gram from row_words),
    row_runs as (select {row_id}, count(*) as runs from row_grams group by 1),
    row_gains as (select {row_id}, lang, sum(gain) as gained from row_grams join gains using (gram) group by 1, 2),
    row_scores as (select r.{row_id}, k.lang, runs, 100 * coalesce(gained, 0) - runs * typical * {languages.LEAST_SHARE} as over,
      coalesce(gained, 0) + runs * unseen as score
      from row_runs r cross join known k left join row_gains g on g.{row_id} = r.{row_id} and g.lang = k.lang),
    row_ranked as (select *, row_number() over w as rn, lead(score) over w as next
      from row_scores window w as (partition by {row_id} order by score desc, lang)),
    found as (select s.{row_id}, case when over >= 0
        and (next is null or score - next >= {languages.MARGIN} * runs) then r.lang else 'error' end as language
      from {rows} s left join row_ranked r on r.{row_id} = s.{row_id} and rn = 1)"""


@query(f"with {_sql_letters('documents')} select lang, gram, n, gain from gains")
def letter_profiles(spark, sf_dir):
    """Runs of three characters per language, with integer log weights."""
    return languages.letter_gains(table(spark, sf_dir, "documents"))


@query(
    f"""with {_sql_letters('documents')},
    rows as (select conv_id || '-' || turn as row_id, text from conversations union all
      select 'r' || conv_id || '-' || turn, reverse(text) from conversations),
    {_sql_open_set('rows', 'row_id')}
    select row_id, language from found"""
)
def detect_open_set(spark, sf_dir):
    """Turns as they are and written backwards, which is no language."""
    letters = languages.learn_letters(table(spark, sf_dir, "documents"))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("row_id"), "text")
    backwards = turns.select(F.concat(F.lit("r"), "row_id").alias("row_id"), F.reverse("text").alias("text"))
    return languages.detect_open_set(turns.unionByName(backwards), letters, "row_id")


@query(
    f"""with halves as (select doc_id, lang, text, {sql_random(42, 'doc_id')} < 2147483648 as learn from documents),
    learned as (select lang, text from halves where learn), asked as (select doc_id, lang, text from halves where not learn),
    {_sql_letters('learned')}, {_sql_open_set('asked', 'doc_id')}
    select asked.lang, count(*) as n, cast(sum(cast(asked.lang = language as integer)) as bigint) as n_right,
      cast(sum(cast(language = 'error' as integer)) as bigint) as n_unknown
    from asked join found using (doc_id) group by 1"""
)
def open_set_report(spark, sf_dir):
    """Learned from a random half of the documents; how many of the other half are right and of no language."""
    halves = bucket_split(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", ("learn", "ask"))
    letters = languages.learn_letters(halves.filter("split = 'learn'"))
    asked = halves.filter("split = 'ask'")
    found = asked.join(languages.detect_open_set(asked, letters, "doc_id"), "doc_id")
    return found.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("lang") == F.col("language")).cast("bigint")).alias("n_right"),
        F.sum((F.col("language") == language.UNKNOWN).cast("bigint")).alias("n_unknown"),
    )


@query(
    "select doc_id, array_to_string(string_split(text, chr(10)), ';') as lines from documents"
)
def array_to_text(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", T.array_to_text(T.split_lines(F.col("text"))).alias("lines"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_fields(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("select event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' as record from events")
def json_encode(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.to_json(F.struct("event_type", "user_id")).alias("record"))


@query("select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as bigint) as best from embeddings")
def argmax(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select("vec_id", labels.arg_max(F.col("embedding")).alias("best"))


@query(
    "select vec_id, case label "
    + " ".join(f"when {i} then '{w}'" for i, w in enumerate(fixed.NUMBER_WORDS))
    + " end as word, case label "
    + " ".join(f"when {i} then {quoted([w])}" for i, w in enumerate(fixed.GOAL_NAMES))
    + " end as name from embeddings"
)
def label_words(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings")
    return embeddings.select(
        "vec_id",
        labels.label_word(F.col("label")).alias("word"),
        labels.goal_name(F.col("label")).alias("name"),
    )


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H-%M') as run_time from orders")
def run_time(spark, sf_dir):
    from labelloom.sources.writers import run_time as stamp

    return table(spark, sf_dir, "orders").select("o_orderkey", stamp(F.col("o_orderdate")).alias("run_time"))


@query("select c_custkey, cast(c_custkey as varchar) as id from customer")
def id_prefix(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    landed = F.concat(F.lit("oai:repository.example.org:"), F.col("c_custkey").cast("string"))
    return customers.select("c_custkey", T.strip_id_prefix(landed).alias("id"))


@query(
    "select s_suppkey, trim(s_name) as name from supplier"
)
def strip_cells(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    padded = F.concat(F.lit(" \n \t"), F.col("s_name"), F.lit("  \n"))
    return suppliers.select("s_suppkey", T.strip_blanks(padded).alias("name"))
