"""Text operators: token search with BM25 weights, lexicon scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, token, tf, len: token counts of each text (runs of ASCII letters and digits in lower case, single CJK characters)."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[a-z0-9]+|[一-鿿]"), F.lit(0))
    each = df.select(F.col(id_col), words.alias("_w")).withColumn("len", F.size("_w"))
    return each.select(id_col, "len", F.explode("_w").alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def _count(token: str):
    return F.size(F.filter("_w", lambda w: w == F.lit(token)))


def search(df: DataFrame, query: str, id_col: str, text_col: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score: BM25 over texts with any token of the query. Only the query's tokens are exploded past the filter; document counts come from one aggregate."""
    wanted = sorted(set(query.lower().split()))
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(r"[a-z0-9]+|[一-鿿]"), F.lit(0))
    docs = df.select(F.col(id_col), words.alias("_w")).select(id_col, F.size("_w").alias("len"), *(_count(t).alias(f"_t{i}") for i, t in enumerate(wanted)))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *(F.sum((F.col(f"_t{i}") > 0).cast("long")).alias(f"_d{i}") for i in range(len(wanted)))).first()
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df_t = F.col(f"_t{i}").cast("double"), stats[f"_d{i}"] or 0
        idf = float(math.log(1 + ((stats["n"] or 0) - df_t + 0.5) / (df_t + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / (stats["avg_len"] or 1.0)))
    return docs.select(id_col, score.alias("score")).where("score > 0")


def lexicon_score(df: DataFrame, positive: list[str], negative: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, hits, score: (positive - negative) / hits over lower-cased words without outer punctuation; 0 without hits."""
    words = F.transform(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    d = df.select(F.col(id_col), words.alias("_w"))
    count = lambda xs: F.size(F.filter("_w", lambda w: w.isin(xs)))
    d = d.select(id_col, count(positive).alias("_p"), count(negative).alias("_n"))
    return d.select(id_col, (F.col("_p") + F.col("_n")).alias("hits"), F.coalesce(F.try_divide(F.col("_p") - F.col("_n"), F.col("_p") + F.col("_n")), F.lit(0.0)).alias("score"))
