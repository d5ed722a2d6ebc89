"""Text functions: hand-derived values and a second oracle in Python's re."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelloom import fixed
from labelloom.functions import labels, language
from labelloom.functions import text as T


@pytest.mark.parametrize(
    "value, expected",
    [
        ("p < 0.05 and n > 30", "p  30"),
        ("a<b\nc>d", "a<b\nc>d"),
        ("a<b\rc>d", "ad"),
        ("<i>x</i>", "x"),
    ],
)
def test_strip_html(column, value, expected):
    assert column(T.strip_html, value) == expected


def test_strip_urls_takes_punctuation_along(column):
    assert column(T.strip_urls, "see https://x.org/a. Next") == "see  Next"
    assert column(T.strip_urls, "see www.x.org/a Next") == "see  Next"


def test_strip_digits_of_every_script(column):
    assert column(T.strip_digits, "a1٣b") == "ab"


@pytest.mark.parametrize(
    "value, expected",
    [
        (
            "<p>Not all 3 Models are state-of-the-art; see https://x.org/a.</p>",
            "not model see",
        ),
        ("", ""),
        (None, None),
        ("We don't and can't; women's dogs' tails.", "ca woman dog tail"),
        ("Cannot go, e.g. and/or n/a. No. Never!", "not go no never"),
        ("word--word a.b c*d (x) “quoted”", "word word c x quoted"),
        ("Dr. Smith met dr.", "smith met dr"),
    ],
)
def test_process_text(column, value, expected):
    assert column(T.process_text, value) == expected


def test_process_text_is_stable_on_its_own_output(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    once = T.remove_stop_words(T.alpha_tokens(T.clean_before_tokens(F.col("text"))))
    rows = documents.select(F.array_join(once, " ").alias("once"))
    again = T.remove_stop_words(T.alpha_tokens(T.clean_before_tokens(F.col("once"))))
    assert rows.filter(F.array_join(again, " ") != F.col("once")).count() == 0


def test_process_text_properties(spark, sf_dir):
    cleaned = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        T.process_text(F.col("html")).alias("t")
    )
    for (text,) in cleaned.collect():
        tokens = text.split(" ") if text else []
        assert all(t.isalpha() for t in tokens)
        assert text == text.lower()


@pytest.mark.parametrize(
    "word, lemma",
    [
        ("models", "model"), ("studies", "study"), ("classes", "class"), ("analyses", "analysis"),
        ("species", "specie"), ("women", "woman"), ("specimen", "specimen"), ("analysis", "analysis"),
        ("viruses", "virus"), ("causes", "cause"), ("process", "process"), ("ties", "tie"),
        ("series", "series"), ("dynamics", "dynamic"), ("economics", "economics"), ("cat", "cat"),
    ],
)
def test_lemmatize_noun(column, word, lemma):
    assert column(T.lemmatize_noun, word) == lemma


def test_stop_words_keep_sentiment():
    assert len(fixed.STOP_WORDS) == len(set(fixed.STOP_WORDS)) == 179
    assert {"not", "no", "nor", "should"} <= set(fixed.STOP_WORDS)
    assert not set(fixed.SENTIMENT_WORDS) & set(fixed.REMOVED_STOP_WORDS)


@pytest.mark.parametrize(
    "value, expected",
    [
        ('Here is a paper on Web of Science "Forest', '"Forest'),
        ("ends with Web of Science", "ends with Web of Science"),
        ("this abstract covers X", "covers X"),
        ("Abstract: Y", "Abstract: Y"),
    ],
)
def test_clean_synthetic_text(column, value, expected):
    assert column(T.clean_synthetic_text, value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("Sure! Abstract: Low-income & poor\n\nhomes", ": Low income poor homes"),
        ("Abstract A Abstract B", "Abstract A Abstract B"),
        ("cross-sectional – café", "cross sectional caf"),
    ],
)
def test_clean_model_output(column, value, expected):
    assert column(T.clean_model_output, value) == expected


def test_numbered_lists(column):
    assert column(T.strip_numbered_lists, "1. One\n2. Two\nA 3. x") == "One\nTwo\nA 3. x"


def test_markers(column):
    for text, flag in (("Abstraction", 1), ("This Study", 1), ("paper", 0), (None, 0)):
        assert column(T.marker_flag, text) == flag


def test_id_prefix(column):
    assert column(T.strip_id_prefix, "oai:repository.example.org:123") == "123"
    assert column(lambda c: T.strip_id_prefix(c, "x.y:"), "x.y:7") == "7"


def test_array_to_text(column):
    for value, expected in ((None, None), ([], ""), (["a"], "a"), (["a", "b"], "a;b")):
        assert column(T.array_to_text, value, "array<string>") == expected


def test_truncate_tokens(column):
    assert column(lambda c: T.truncate_tokens(c, 2), ["a", "b", "c"], "array<string>") == ["a", "b"]


def test_arg_max_takes_the_first(column):
    assert column(labels.arg_max, [0.1, 0.7, 0.7], "array<double>") == 1


def test_label_words(column):
    assert column(labels.label_word, "3") == "three"
    assert column(labels.label_word, "label") == "label"
    assert column(labels.label_word, 0, "int") == "zero"
    assert column(labels.goal_name, 2, "int") == "Zero Hunger"
    with pytest.raises(Exception, match="unknown class"):
        column(labels.label_word, "18")


def test_model_short_name(column):
    assert column(labels.model_short_name, "gpt-4-turbo") == "gpt-4-turbo"
    assert column(labels.model_short_name, "meta-llama/Llama-3-70b-chat-hf") == "llama-3-70b"


def test_detect_language(column):
    assert column(language.detect_language, "the cat is on the table") == "en"
    assert column(language.detect_language, "der Hund und die Katze sind nicht da") == "de"
    for nothing in (None, "", "12 xyz"):
        assert column(language.detect_language, nothing) == "error"


def test_other_languages_have_names_of_their_own(column):
    assert column(language.detect_language, "de mensen van deze stad hebben om meer tijd gevraagd omdat het werk niet klaar is") == "nl"
    assert column(language.detect_language, "la gente di questa città ha chiesto più tempo perché il lavoro non è finito") == "it"
    assert column(language.detect_language, "as pessoas pediram mais tempo porque o trabalho ainda não foi terminado") == "pt"


def test_detect_language_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hit = (language.detect_language(F.col("text")) == F.col("lang")).cast("int")
    assert documents.agg(F.avg(hit)).first()[0] > 0.95


# --- second oracle -----------------------------------------------------------------

ALPHABET = list("aZ1 .<>'\n\r\t,-/") + [
    "\u00a0", "\u0085", "\u2003", "\u2028", "\u3000", "\x1c", "\u0663", "é", "²",
    "http://", "https://", "www.", "1. ", "Abstract", "abstract ", "Web of Science ", "Web of Science",
]


def _strings(n=3000):
    rng = random.Random(7)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


def _clean_output(text):
    parts = text.split("Abstract")
    text = parts[-1] if len(parts) == 2 else text
    text = re.sub(r"[^A-Za-z0-9(),.:!?\"']", " ", text)
    return re.sub(r"\s{2,}", " ", text).strip()


def _clean_synthetic(text):
    for marker in ("Web of Science", "abstract"):
        if marker in text:
            return text.split(marker + " ")[-1]
    return text


@pytest.mark.parametrize(
    "function, reference",
    [
        (T.strip_html, lambda s: re.sub(r"<.*?>", "", s)),
        (T.strip_urls, lambda s: re.sub(r"https?://\S+|www\.\S+", "", s)),
        (T.strip_digits, lambda s: re.sub(r"\d+", "", s)),
        (T.strip_numbered_lists, lambda s: re.sub(r"(?m)^\d+\.\s+", "", s)),
        (T.strip_blanks, lambda s: s.strip()),
        (T.clean_model_output, _clean_output),
        (T.clean_synthetic_text, _clean_synthetic),
    ],
)
def test_against_python_patterns(spark, function, reference):
    rows = spark.createDataFrame([(s,) for s in _strings()], "s string")
    for text, found in rows.select("s", function(rows.s).alias("f")).collect():
        assert found == reference(text), repr(text)


def test_process_text_uses_no_python(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = documents.select(T.process_text(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "INSET" in plan
