"""Quality rules on the level of hosts.

Every text is measured and tested by the base rules. Failures are summed by host; the
rate of a host is shrunk towards that of all hosts by a beta prior whose two parameters
are fitted to the hosts' own rates (method of moments). A host whose shrunk rate passes
the threshold is rejected with all its documents.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import BLANK, map_texts, query, table
from labelloom.sources.staging import stage

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Base rules: fewest words, and the largest share of words in repeated windows, in percent.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Words in a window.
WINDOW = 3
#: Shrunk failure rate from which a host is rejected.
MOST_FAILED = 0.5

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measures(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    words = text.encode().split()
    n = len(words)
    blanks = sum(map(text.count, BLANK))
    symbols = sum(map(text.count, SYMBOLS))
    lines: set[str] = set()
    repeated_lines = 0
    for line in text.split("\n"):
        if line in lines:
            repeated_lines += 1
        elif line.strip(BLANK):
            lines.add(line)
    repeated = 0
    if n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW))))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            hit = bytearray(n)
            for at, window in enumerate(windows):
                if counts[window] > 1:
                    hit[at : at + WINDOW] = b"\1" * WINDOW
            repeated = sum(hit)
    return n, len(text) - blanks, symbols, repeated_lines, repeated


def measured(df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Key, host, measures and base verdict of every text; a null text has no words."""
    rows = map_texts(df, {key: key, "host": host}, text, lambda: measures, FIELDS)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, most_failed: float = MOST_FAILED) -> DataFrame:
    """Host, documents, failures, shrunk rate and verdict, from one summed row per host.

    The prior is Beta(m s, (1 - m) s): m is the rate over all documents, s follows from
    the spread of the hosts' rates beyond what chance explains. Without such a spread,
    or with one host, every host gets the common rate. A null host is a host.
    """
    hosts = rows.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    sums = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("f"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("n").cast("double") ** 2).alias("nn"),
        F.sum(F.col("failed").cast("double") ** 2 / F.col("n")).alias("ff"),
    ).first()
    if not sums.n:
        mean, strength = 0.5, 1.0
    else:
        mean = sums.f / sums.n
        # Between-host variance of the rates: weighted spread less the binomial part.
        spread = sums.ff - sums.n * mean**2
        scale = sums.n - sums.nn / sums.n
        chance = mean * (1 - mean)
        between = (spread - (sums.h - 1) * chance) / scale if scale > 0 else 0.0
        strength = max(chance / between - 1, 1.0) if between > 1e-9 * max(chance, 1e-9) else 1e9
    rate = (F.col("failed") + mean * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "failed", rate.alias("rate"), (rate < most_failed).alias("host_kept"))


def judge(
    df: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", most_failed: float = MOST_FAILED
) -> DataFrame:
    """Measures, base verdict, the host's shrunk rate and the final verdict of every document.

    Null texts fail as having no words; null hosts form one host; repeated rows each
    count and stay; other columns are left out. An empty table gives an empty result.
    """
    rows = stage(measured(df, key, text, host), "host-measures")
    verdicts = host_verdicts(rows, most_failed).select(F.col("host").alias("_host"), "rate", "host_kept")
    joined = rows.join(verdicts, rows["host"].eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_kept"))


SQL_7 = r"""
with t as (
  select row_number() over () as rid, doc_id, source, coalesce(text, '') as text from documents),
w as (
  select *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
         string_split(text, chr(10)) as lines from t),
g as (
  select *, len(words) as n,
    list_transform(range(1, greatest(len(words) - 1, 1)),
      lambda i: words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2]) as grams from w),
e as (select rid, unnest(grams) as gram, generate_subscripts(grams, 1) as pos from g),
d as (select rid, pos from (select rid, pos, count(*) over (partition by rid, gram) as c from e) where c > 1),
p as (select rid, count(distinct pos + k) as n_repeat from d, (values (0), (1), (2)) o(k) group by rid),
l as (select rid, unnest(lines) as line from g),
r as (select rid, sum(c - 1) as n_dup from (
        select rid, line, count(*) as c from l
        where regexp_matches(line, '[^\x20\x09-\x0D]') group by all) group by rid),
m as (
  select g.rid, doc_id, source, n::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_repeat, 0)::bigint as n_repeat_words
  from g left join p on g.rid = p.rid left join r on g.rid = r.rid),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
h as (select source, count(*)::double as n, sum(base_failed::int)::double as f from v group by source),
s as (select sum(n) as sn, sum(f) / sum(n) as mean, count(*) as hs, sum(n * n) as nn, sum(f * f / n) as ff from h),
b as (select mean, mean * (1 - mean) as chance,
        case when sn - nn / sn > 0
          then (ff - sn * mean * mean - (hs - 1) * mean * (1 - mean)) / (sn - nn / sn) else 0 end as between_hosts
      from s),
q as (select mean, case when between_hosts > 1e-9 * greatest(chance, 1e-9)
        then greatest(chance / between_hosts - 1, 1.0) else 1e9 end as strength from b),
z as (select source, (f + mean * strength) / (n + strength) < 0.5 as host_kept from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and host_kept as kept
from v join z on v.source is not distinct from z.source
"""


@query("op7_host_rules", SQL_7)
def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
