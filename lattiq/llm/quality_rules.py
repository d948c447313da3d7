"""Quality rules: a table of thresholds compiled into one projection of Spark functions, without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Frequent short words of the languages served (fixed values).
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be", "by", "on", "are", "this", "as", "at", "or", "an", "a",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "du", "que", "qui", "dans", "pour", "par", "sur", "au", "avec", "est",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "el", "los", "las", "y", "se", "del", "por", "con", "una", "su", "para", "al", "lo", "como",
]

#: (rule, measure, least, most); None: no bound. A document is kept if every measure lies within its bounds.
RULES = [
    ("length", "n_words", 50, None),
    ("word length", "mean_word_chars", 2.0, 15.0),
    ("symbols", "symbols_per_word", None, 0.35),
    ("shouting", "exclamations_per_word", None, 0.35),
    ("stop words", "stop_word_share", 0.05, None),
    ("repeated lines", "dup_line_share", None, 0.4),
]

_WORDS = r"CASE WHEN _text IS NULL OR btrim(_text, ' \t\n\u000b\u000c\r') = '' THEN cast(array() AS array<string>) ELSE split(btrim(_text, ' \t\n\u000b\u000c\r'), '[\\x20\\x09-\\x0D]+') END"


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The raw counts and ratios that the rules use, one row per document.

    A null text counts as no text: no words, no lines, all counts 0, all ratios 0. Texts of any length are taken whole: the
    three-word windows of a document are sorted by their hash inside its row, so equal windows meet as neighbours, and those that meet are told apart by their words.
    """
    d = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    d = d.withColumn("_words", F.expr(_WORDS))
    d = d.select(
        id_col,
        F.size("_words").alias("_n"),
        F.expr(r"char_length(translate(_text, ' \t\n\u000b\u000c\r', ''))").alias("_chars"),
        F.expr("char_length(_text) - char_length(translate(_text, '#*$%&|<>', ''))").alias("_symbols"),
        F.expr("char_length(_text) - char_length(translate(_text, '!', ''))").alias("_shouts"),
        F.expr(r"filter(split(_text, '\n'), l -> btrim(l, ' \t\n\u000b\u000c\r') != '')").alias("_lines"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))).alias("_stops"),
        F.expr("cast(ceil(log2(size(_words) + 2)) AS int)").alias("_bits"),
        "_words",
    )
    # The hash of a window above its index: one sort of longs brings equal windows together. The index takes bits from the hash, so windows that meet there are compared by their words.
    d = d.withColumn(
        "_grams",
        F.expr("CASE WHEN _n < 3 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(sequence(0, _n - 3), i -> shiftleft(xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2)), _bits) + i)) END"),
    )
    d = d.withColumn(
        "_met",
        F.expr(
            "sort_array(transform(filter(sequence(0, greatest(_n - 3, 0)), k -> shiftright(get(_grams, k), _bits) = shiftright(get(_grams, k - 1), _bits) OR shiftright(get(_grams, k), _bits) = shiftright(get(_grams, k + 1), _bits)), "
            "k -> named_struct('g', array_join(slice(_words, cast((get(_grams, k) & (shiftleft(1L, _bits) - 1)) AS int) + 1, 3), ' '), 'i', get(_grams, k) & (shiftleft(1L, _bits) - 1))))"
        ),
    ).drop("_grams", "_words")
    d = d.withColumn(
        "_again",
        F.expr("CASE WHEN size(_met) = 0 THEN cast(array() AS array<bigint>) ELSE sort_array(transform(filter(sequence(0, size(_met) - 1), k -> get(_met, k).g = get(_met, k - 1).g OR get(_met, k).g = get(_met, k + 1).g), k -> get(_met, k).i)) END"),
    ).drop("_met")
    return d.select(
        id_col,
        F.col("_n").cast("long").alias("n_words"),
        F.col("_chars").cast("long").alias("word_chars"),
        F.col("_symbols").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(_again) = 0 THEN 0L ELSE aggregate(sequence(1, size(_again)), 3L, (a, k) -> a + CASE WHEN k < size(_again) THEN least(3L, get(_again, k) - get(_again, k - 1)) ELSE 0L END) END").alias("n_repeat_words"),
        (F.col("_chars") / F.greatest("_n", F.lit(1))).alias("mean_word_chars"),
        (F.col("_symbols") / F.greatest("_n", F.lit(1))).alias("symbols_per_word"),
        (F.col("_shouts") / F.greatest("_n", F.lit(1))).alias("exclamations_per_word"),
        (F.col("_stops") / F.greatest("_n", F.lit(1))).alias("stop_word_share"),
        ((F.size("_lines") - F.size(F.array_distinct("_lines"))) / F.greatest(F.size("_lines"), F.lit(1))).alias("dup_line_share"),
    )


def compile_rules(rules=RULES) -> Column:
    """The threshold table as one boolean column."""
    kept = F.lit(True)
    for _, measure, least, most in rules:
        if least is not None:
            kept = kept & (F.col(measure) >= least)
        if most is not None:
            kept = kept & (F.col(measure) <= most)
    return kept


def apply_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Counts, base_failed and kept per document. Repeated rows are judged each; an empty table gives no rows; other columns are not read."""
    d = measures(df, id_col, text_col)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & compile_rules(rules)).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


def _bound(measure: str, least, most) -> str:
    return " AND ".join([f"{measure} >= {least}"] * (least is not None) + [f"{measure} <= {most}"] * (most is not None))


QUALITY_RULES_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) AS n_lines FROM lines GROUP BY doc_id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_shouts,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))})))::BIGINT AS n_stops,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
r AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_shouts / greatest(n_words, 1) AS exclamations_per_word,
    n_stops / greatest(n_words, 1) AS stop_word_share, n_dup_lines / greatest(n_lines, 1) AS dup_line_share,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(_bound(*r[1:]) for r in RULES)} AS kept
FROM r
"""
