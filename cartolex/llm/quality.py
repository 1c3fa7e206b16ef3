"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. A rule's outcome is one bit of
``failures``; the figures it looked at are stored beside it. A policy is a
versioned mask over those bits, so another policy, or leaving out a rule, needs
bitwise arithmetic on the ledger and no text. Built-in SQL functions only.

Defined cases: a null or empty text has no words and fails ``few_words``;
repeated rows are judged one by one; extra columns are not touched by
``apply_policy`` and not read by ``ledger``; an empty table gives an empty
ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    Rule(5, "capitals", "100 * n_upper > 40 * word_chars"),
    Rule(6, "digits", "100 * n_digits > 30 * word_chars"),
)
BASE_MASK = 0b11
#: version -> mask of the rules that reject
POLICIES = {1: 0b0000011, 2: 0b0001111, 3: 0b1111111}
CURRENT = 3
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits")


def _without(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in ``chars``."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


def _long(c: Column) -> Column:
    return c.cast("long")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements and ``failures`` (bit set of failed rules), a row per input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = own.withColumn("w", F.filter(F.split("text", WORD_BREAK), lambda x: x != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    word = lambda i, k: F.get(F.col("w"), i + k)
    windows = F.when(F.size("w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.xxhash64(*(word(i, k) for k in range(WINDOW))))).otherwise(F.expr("cast(array() as array<bigint>)"))
    measured = split.select(
        "doc_id",
        _long(F.size("w")).alias("n_words"),
        _long(F.char_length("text") - _without(F.col("text"), BLANKS)).alias("word_chars"),
        _long(_without(F.col("text"), SYMBOLS)).alias("n_symbols"),
        _long(_without(F.col("text"), UPPER)).alias("n_upper"),
        _long(_without(F.col("text"), DIGITS)).alias("n_digits"),
        lines.alias("lines"),
        windows.alias("h"),
    )
    # Only a text with a repeated window sorts its windows to find where they are.
    nothing = F.expr("cast(array() as array<struct<h:bigint,p:int>>)")
    placed = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.cast("int").alias("p"))))
    measured = measured.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_upper", "n_digits",
        _long(F.size("lines")).alias("n_lines"),
        _long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h")) == F.size("h"), nothing).otherwise(placed).alias("s"),
    )
    near = lambda i: F.get(F.col("s"), i)["h"]
    again = F.filter("s", lambda x, i: F.coalesce(x["h"] == near(i - 1), F.lit(False)) | F.coalesce(x["h"] == near(i + 1), F.lit(False)))
    measured = measured.withColumn("p", F.sort_array(F.transform(again, lambda x: x["p"]))).drop("s")
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    measured = measured.withColumn("n_repeat_words", _long(covered)).select("doc_id", *MEASURES)
    bits = sum((F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)) for r in RULES), F.lit(0))
    return measured.withColumn("failures", bits.cast("long"))


def apply_policy(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """The ledger with ``base_failed``, ``policy`` and ``kept``; no rule is evaluated again."""
    return book.withColumns({
        "base_failed": F.col("failures").bitwiseAND(F.lit(BASE_MASK)) != 0,
        "policy": F.lit(version),
        "kept": F.col("failures").bitwiseAND(F.lit(POLICIES[version] | BASE_MASK)) == 0,
    })


def ablations(book: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would be kept without it.

    The ledger is first counted by bit pattern (at most 2**rules rows), so the
    ablations cost the same whatever the number of documents.
    """
    mask = POLICIES[version] | BASE_MASK
    patterns = book.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if mask >> r.bit & 1)))
    each = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_regained"),
    )


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def quality_cte(docs: str) -> str:
    """DuckDB CTEs ``q_words``, ``q_repeat`` and ``quality`` over a table with doc_id and text."""
    fails = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)
    return rf"""
q_words AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ln
  FROM {docs}),
q_windows AS (
  SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM q_words WHERE len(w) >= 5)),
q_again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM q_windows) WHERE k > 1),
q_repeat AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM q_again) GROUP BY doc_id),
q_measured AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ln)::BIGINT AS n_lines,
         (len(ln) - len(list_distinct(ln)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^0-9]', '', 'g'))::BIGINT AS n_digits
  FROM q_words LEFT JOIN q_repeat r USING (doc_id)),
q_failed AS (SELECT *, ({fails})::BIGINT AS failures FROM q_measured),
quality AS (
  SELECT *, (failures & {BASE_MASK}) <> 0 AS base_failed, {CURRENT} AS policy, (failures & {POLICIES[CURRENT] | BASE_MASK}) = 0 AS kept FROM q_failed)"""


OP5_SQL = f"WITH {quality_cte('documents')} SELECT * FROM quality"
