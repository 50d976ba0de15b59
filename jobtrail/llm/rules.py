"""Quality rules as a bitmask ledger (DataFrame functions only).

``ledger`` evaluates every rule once and stores, for each document, the measurements and one integer whose
bit ``i`` is set when rule ``i`` fails. A policy is a version and a mask of rules; applying it, or
asking what each rule alone costs, needs only the bits. No step shuffles texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.mixing import WORD

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rules in the order of their bits: name and SQL condition of failure over the measurements.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 8 * word_chars"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 25 * n_words"),
    ("capitals", "100 * n_capitals > 40 * word_chars"),
    ("exclamations", "100 * n_exclamations > 5 * word_chars"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: the rules that reject.
POLICIES = {
    1: ("few_words", "repeated_words"),
    2: tuple(BIT),
}


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words found twice or more in the same text."""
    windows = F.when(F.size(words) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(s: Column) -> Column:
        again = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False)))
        places = F.sort_array(F.transform(again, lambda e: e["p"]))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                           lambda a, p: F.struct((a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - p)).alias("n"), (p + WINDOW).alias("end")))["n"]

    placed = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(placed(h), covered)))


def measure(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> ``doc_id`` and the measurements that ``RULES`` read, as longs."""
    text = F.coalesce("text", F.lit(""))
    bare = F.trim(text, F.lit(SPACES))
    words = F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    found = docs.select(
        "doc_id",
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        _count(text, SYMBOLS).alias("n_symbols"),
        _count(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_capitals"),
        _count(text, "!").alias("n_exclamations"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("lines"),
        _let(hashes, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("words"))
    longs = {c: F.col(c) for c in ("word_chars", "n_symbols", "n_capitals", "n_exclamations")} | {c: F.col(f"lines.{c}") for c in ("n_lines", "n_dup_lines")} | {c: F.col(f"words.{c}") for c in ("n_words", "n_repeat_words")}
    return found.select("doc_id", *(e.cast("long").alias(c) for c, e in longs.items()))


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and ``failed`` (bitmask) of each row of ``docs (doc_id, text)``.

    A null text measures as an empty one, which fails ``few_words`` alone; a null id stays null;
    repeated rows are measured each; an empty table gives an empty ledger; further columns are ignored.
    """
    bits = [F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, condition) in enumerate(RULES)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs).withColumn("failed", failed.cast("long"))


def mask(version: int) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def apply_policy(entries: DataFrame, version: int) -> DataFrame:
    """``kept``: whether no rule of the policy failed."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask(version))) == 0)


def ablation(entries: DataFrame) -> DataFrame:
    """For each policy and rule of it: documents that fail the rule, that fail it alone (and would stay
    without it), and that the policy keeps. Works on the counts of distinct masks, of which there are few."""
    spark = entries.sparkSession
    rows = [(v, name, BIT[name], mask(v)) for v, names in POLICIES.items() for name in names]
    policies = spark.createDataFrame(rows, "version int, rule string, bit long, mask long")
    counts = entries.groupBy("failed").agg(F.count("*").alias("n"))
    each = counts.select("n", "failed", F.explode(F.array([F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("version", "rule", "bit", "mask")))) for r in rows])).alias("p")).select("n", "failed", "p.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    when = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    found = each.groupBy("version", "rule").agg(when(F.col("failed").bitwiseAND(F.col("bit")) != 0).alias("fails"), when(hit == F.col("bit")).alias("fails_alone"), when(hit == 0).alias("kept"))
    return policies.select("version", "rule").join(found, ["version", "rule"], "left").fillna(0)


def ledger_sql(table: str = "documents", version: int = 2) -> str:
    """The rows of the query in DuckDB SQL."""
    word = WORD.replace("'", "''")
    cast = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    failed = " | ".join(f"(CASE WHEN {c} THEN {1 << i} ELSE 0 END)" for i, (_, c) in enumerate(RULES))
    return rf"""
WITH numbered AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS text FROM {table}),
split AS (SELECT *, regexp_extract_all(text, '{word}') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines FROM numbered),
windows AS (SELECT row_no, unnest(range(1, len(words) - {WINDOW - 2})) AS place, words FROM split WHERE len(words) >= {WINDOW}),
keyed AS (SELECT row_no, place, array_to_string(words[place:place + {WINDOW - 1}], ' ') AS said FROM windows),
again AS (SELECT row_no, place FROM keyed QUALIFY count(*) OVER (PARTITION BY row_no, said) > 1),
covered AS (SELECT row_no, sum(least({WINDOW}, coalesce(following - place, {WINDOW}))) AS n
    FROM (SELECT row_no, place, lead(place) OVER (PARTITION BY row_no ORDER BY place) AS following FROM again) GROUP BY row_no),
measured AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals, len(regexp_extract_all(text, '!')) AS n_exclamations,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN covered USING (row_no)),
judged AS (SELECT *, CAST({failed} AS BIGINT) AS failed FROM measured)
SELECT doc_id, {cast}, failed & 3 <> 0 AS base_failed, failed & {mask(version)} = 0 AS kept, failed FROM judged
"""
