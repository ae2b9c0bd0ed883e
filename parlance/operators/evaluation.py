"""Scoring predicted notes and transcripts against references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.functions import overlap
from parlance.functions.rows import inline_rows
from parlance.functions.sections import SECTIONS
from parlance.functions.text import normalise, tokens

METRICS = [
    "precision", "recall", "f1", "rouge1_f1", "rouge2_f1", "rougeL_f1",
    "exact_match", "section_presence_acc",
]


def unpivot_sections(notes: DataFrame, keys: list[str], note: str = "note") -> DataFrame:
    """One row per (note, section)."""
    parts = [F.struct(F.lit(s).alias("section"), F.col(f"{note}.{s}").alias("text")) for s in SECTIONS]
    return inline_rows(notes, keys, F.array(*parts))


def pair_predictions(pred: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions joined with references; ``require_pairs`` checks that some match."""
    return pred.withColumnRenamed("text", "pred").join(
        ref.withColumnRenamed("text", "ref"), keys, "inner"
    )


def require_pairs(pairs: DataFrame) -> DataFrame:
    if pairs.isEmpty():
        raise ValueError("no overlapping session ids between predictions and references")
    return pairs


def unmatched_counts(pred: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Sessions only predicted, only referenced, and in both."""
    p = pred.select(key).distinct().withColumn("_p", F.lit(True))
    r = ref.select(key).distinct().withColumn("_r", F.lit(True))
    return p.join(r, key, "full").agg(
        F.count_if(F.col("_p") & F.col("_r")).alias("matched_sessions"),
        F.count("_p").alias("pred_sessions"),
        F.count("_r").alias("ref_sessions"),
        F.count_if(F.col("_r").isNull()).alias("unmatched_pred_sessions"),
        F.count_if(F.col("_p").isNull()).alias("unmatched_ref_sessions"),
    )


def with_tokens(pairs: DataFrame) -> DataFrame:
    """Token arrays of both texts, made once for all metrics."""
    return pairs.withColumn("_p", tokens(F.col("pred"))).withColumn("_r", tokens(F.col("ref")))


def token_prf(pairs: DataFrame) -> DataFrame:
    scored = with_tokens(pairs).withColumn("_s", overlap.token_prf(F.col("_p"), F.col("_r")))
    return scored.select(*pairs.columns, "_s.*")


def rouge_n(pairs: DataFrame, n: int) -> DataFrame:
    score = overlap.rouge_n(F.col("_p"), F.col("_r"), n)
    return with_tokens(pairs).select(*pairs.columns, score.alias(f"rouge{n}_f1"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    score = overlap.rouge_l(F.col("_p"), F.col("_r"))
    return with_tokens(pairs).select(*pairs.columns, score.alias("rougeL_f1"))


def matches(pairs: DataFrame) -> DataFrame:
    p, r = normalise(F.col("pred")), normalise(F.col("ref"))
    return pairs.withColumn("exact_match", overlap.exact_match(p, r)).withColumn(
        "section_presence_acc", overlap.presence_match(p, r)
    )


def score_pairs(pairs: DataFrame) -> DataFrame:
    """All eight metrics per row, from one tokenisation; unigram overlap serves two of them."""
    p, r = F.col("_p"), F.col("_r")
    scored = with_tokens(pairs).withColumn("_s", overlap.token_prf(p, r))
    return scored.select(
        *pairs.columns, "_s.*", F.col("_s.f1").alias("rouge1_f1"),
        overlap.rouge_n(p, r, 2).alias("rouge2_f1"), overlap.rouge_l(p, r).alias("rougeL_f1"),
        ((p == r) & (F.size(p) > 0)).cast("double").alias("exact_match"),
        ((F.size(p) > 0) == (F.size(r) > 0)).cast("double").alias("section_presence_acc"),
    )


def section_means(scored: DataFrame) -> DataFrame:
    return scored.groupBy("section").agg(*[F.avg(m).alias(m) for m in METRICS])


def eval_report(scored: DataFrame) -> DataFrame:
    """Mean per section, and the mean of those means as section ``macro``."""
    means = section_means(scored)
    macro = means.agg(*[F.avg(m).alias(m) for m in METRICS]).withColumn("section", F.lit("macro"))
    return means.unionByName(macro)


def long_metrics(report: DataFrame) -> DataFrame:
    return report.unpivot(["section"], METRICS, "metric", "value")


def compare_runs(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Candidate minus baseline per section and metric; a missing value counts as 0."""
    b = long_metrics(baseline).withColumnRenamed("value", "baseline")
    c = long_metrics(candidate).withColumnRenamed("value", "candidate")
    return (
        b.join(c, ["section", "metric"], "full")
        .fillna(0.0, ["baseline", "candidate"])
        .withColumn("delta", F.col("candidate") - F.col("baseline"))
    )


def char_errors(pairs: DataFrame) -> DataFrame:
    """Character edits and reference length of normalised texts."""
    p, r = normalise(F.col("pred")), normalise(F.col("ref"))
    return pairs.withColumn("char_edits", F.levenshtein(p, r).cast("long")).withColumn(
        "ref_chars", F.length(r).cast("long")
    )


def word_errors(pairs: DataFrame) -> DataFrame:
    """Word edits and reference length of normalised texts."""
    p, r = tokens(F.col("pred")), tokens(F.col("ref"))
    return pairs.withColumn("word_edits", overlap.word_distance(p, r)).withColumn(
        "ref_words", F.size(r).cast("long")
    )


def corpus_rate(errors: DataFrame, edits: str, size: str, name: str, by: list[str] | None = None) -> DataFrame:
    """100 · edits / reference size over the whole corpus or per group."""
    return errors.groupBy(*(by or [])).agg(
        F.round(100.0 * F.sum(edits) / F.sum(size), 2).alias(name), F.count("*").alias("n_samples")
    )


def error_by_language(pairs: DataFrame, min_samples: int = 2) -> DataFrame:
    """Word and character error rate per language with at least two samples."""
    both = word_errors(char_errors(pairs))
    return (
        both.groupBy("language")
        .agg(
            F.round(100.0 * F.sum("word_edits") / F.sum("ref_words"), 2).alias("wer"),
            F.round(100.0 * F.sum("char_edits") / F.sum("ref_chars"), 2).alias("cer"),
            F.count("*").alias("n_samples"),
        )
        .filter(F.col("n_samples") >= min_samples)
    )


def worst_k(scored: DataFrame, metric: str, ties: list[str], k: int = 20) -> DataFrame:
    return scored.orderBy(F.col(metric).desc(), *[F.col(t).asc() for t in ties]).limit(k)
