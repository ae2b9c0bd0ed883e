"""Checks, samples and summaries for the review of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import scores
from parlance.functions.rows import explode_rows, inline_rows
from parlance.functions.sections import SECTIONS
from parlance.functions.text import latin_ratio
from parlance.operators.ordering import head_rows, seeded_hash

# Section and note length limits and the share of Latin characters allowed.
MIN_SECTION_CHARS, SHORT_NOTE, LONG_NOTE = 50, 500, 3000
HIGH_SCORE, PER_STRATUM, MAX_LATIN = 20, 3, 0.3
LANGS = ["english", "marathi"]


def _length(lang: str, section: str) -> Column:
    return F.length(F.coalesce(F.col(f"{lang}.{section}"), F.lit("")))


def _total(lang: str) -> Column:
    total = F.lit(0)
    for s in SECTIONS:
        total = total + _length(lang, s)
    return total


def check_completeness(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Sections shorter than the minimum, per language."""
    parts = [
        F.struct(F.lit(lang).alias("language"), F.lit(s).alias("section"),
                 _length(lang, s).alias("n_chars"))
        for lang in LANGS for s in SECTIONS
    ]
    return inline_rows(notes, keys, F.array(*parts)).filter(F.col("n_chars") < MIN_SECTION_CHARS)


def check_script(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Native notes with too many Latin characters."""
    joined = F.concat_ws(" ", *[F.coalesce(F.col(f"marathi.{s}"), F.lit("")) for s in SECTIONS])
    return (
        notes.select(*keys, latin_ratio(joined).alias("english_ratio"))
        .filter(F.col("english_ratio") > MAX_LATIN)
    )


def expected_severity(score: Column) -> Column:
    return F.when(score.between(0, 24), scores.band(score, scores.EXPECTED_WORDS, None))


def check_consistency(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Assessments that do not name the severity their score stands for."""
    expected = expected_severity(F.coalesce("phq8_score", F.lit(0)))
    said = F.lower(F.coalesce("english.assessment", F.lit("")))
    return (
        notes.select(*keys, "phq8_score", expected.alias("expected"), said.alias("_said"))
        .filter(F.col("expected").isNotNull() & ~F.contains("_said", "expected"))
        .drop("_said")
    )


def note_issues(notes: DataFrame, keys: list[str]) -> DataFrame:
    """All automatic findings as (keys, issue)."""
    short = check_completeness(notes, keys).select(
        *keys,
        F.format_string("%s %s too short (%d chars)", F.initcap("language"), "section", "n_chars")
        .alias("issue"),
    )
    script = check_script(notes, keys).select(*keys, F.lit("too many English characters").alias("issue"))
    severity = check_consistency(notes, keys).select(
        *keys,
        F.format_string("Assessment doesn't mention severity level (PHQ-8: %d)", "phq8_score")
        .alias("issue"),
    )
    return short.unionByName(script).unionByName(severity)


def note_metrics(notes: DataFrame, keys: list[str]) -> DataFrame:
    """Total length per language and sample deviation of the English section lengths."""
    lengths = [_length("english", s).cast("double") for s in SECTIONS]
    mean = sum(lengths[1:], lengths[0]) / len(SECTIONS)
    var = sum(((x - mean) * (x - mean) for x in lengths[1:]), (lengths[0] - mean) * (lengths[0] - mean))
    return notes.select(
        *keys,
        _total("english").alias("english_total_length"),
        _total("marathi").alias("marathi_total_length"),
        F.sqrt(var / (len(SECTIONS) - 1)).alias("section_balance"),
    )


def metric_summary(metrics: DataFrame) -> DataFrame:
    """Mean, sample deviation and range of each note metric."""
    names = ["english_total_length", "marathi_total_length", "section_balance"]
    long = metrics.select(*[F.col(n).cast("double") for n in names]).unpivot(
        [], names, "metric", "value"
    )
    return long.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("stdev"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def stratified_sample(notes: DataFrame, key: Column, per_stratum: int = PER_STRATUM, seed: int = 42) -> DataFrame:
    """Up to ``per_stratum`` notes per severity stratum, chosen by a seeded hash of the key."""
    stratum = scores.band(F.coalesce("phq8_score", F.lit(0)), scores.STRATA)
    return head_rows(
        notes.withColumn("stratum", stratum).withColumn("_h", seeded_hash(key, seed)),
        ["stratum"], [F.col("_h")], per_stratum,
    ).drop("_h")


def edge_cases(notes: DataFrame, keys: list[str]) -> DataFrame:
    """High scores, short notes and long notes, one row per reason."""
    total = _total("english")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("phq8_score") >= HIGH_SCORE, "high_severity"),
            F.when(total < SHORT_NOTE, "too_short"),
            F.when(total > LONG_NOTE, "too_long"),
        )
    )
    return explode_rows(notes, [*keys, "phq8_score", total.alias("total_length")], reasons, "reason")


def review_list(sample: DataFrame, edges: DataFrame, issues: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Distinct notes out of the sample, the first edge cases and the first notes with issues."""
    def first(df: DataFrame) -> DataFrame:
        return df.select(*keys).orderBy(*keys).limit(n)

    return (
        sample.select(*keys)
        .union(first(edges))
        .union(first(issues.select(*keys).distinct()))
        .distinct()
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    """Reviewed and flagged counts per quality with each quality's share."""
    per = reviews.groupBy("quality").agg(
        F.count("*").alias("reviewed"), F.count_if("flagged").alias("flagged")
    )
    everything = Window.partitionBy()
    return per.withColumn("share_pct", 100.0 * F.col("reviewed") / F.sum("reviewed").over(everything))


def correction_stats(reviews: DataFrame) -> DataFrame:
    """Notes to correct and issues found, in total and on average."""
    return reviews.agg(
        F.count("*").alias("reviewed"),
        F.count_if("needs_correction").alias("needs_correction"),
        F.sum(F.size("issues")).alias("total_issues"),
        F.avg(F.size("issues")).alias("avg_issues"),
    )


def quality_distribution(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(F.coalesce("overall_quality", F.lit("unknown")).alias("quality")).agg(
        F.count("*").alias("n")
    )


def batch_progress(done: DataFrame, total: int, last_id: int, started_with: int = 11, seconds_each: int = 120) -> DataFrame:
    """Finished sessions, share of the total, latest id, what is left and how long it takes."""
    # 11 notes existed when timing began; one note takes about 120 s.
    agg = done.agg(F.count("*").alias("generated"), F.coalesce(F.max("session_id"), F.lit(0)).alias("latest_session"))
    left = F.lit(last_id) - F.col("latest_session")
    seconds = left * seconds_each
    return agg.select(
        "generated", "latest_session", left.cast("long").alias("remaining"),
        (F.col("generated") / total * 100).alias("progress_pct"),
        F.when(
            F.col("generated") > started_with,
            F.format_string("%dh %dm", F.floor(seconds / 3600), F.floor(F.pmod(seconds, F.lit(3600)) / 60)),
        ).otherwise("Calculating...").alias("eta"),
    )


def note_conversation(notes: DataFrame, dialects: DataFrame, plain: DataFrame, key: list[str]) -> DataFrame:
    """Each note's conversation from its dialect session, else the plain session, else a remark."""
    d = dialects.select(*key, F.col("conversation").alias("_d"))
    p = plain.select(*key, F.col("conversation").alias("_p"))
    remark = F.concat(F.lit("[Conversation for session "), F.concat_ws("_", *key), F.lit(" not found]"))
    return (
        notes.join(d, key, "left").join(p, key, "left")
        .withColumn("conversation", F.coalesce(F.nullif("_d", F.lit("")), F.nullif("_p", F.lit("")), remark))
        .drop("_d", "_p")
    )


def review_note(reviews: DataFrame, notes: DataFrame, key: list[str]) -> DataFrame:
    """Corrected sections where a review asks for them, the original ones otherwise."""
    return reviews.join(notes, key).withColumn(
        "final", F.when(F.coalesce("needs_correction", F.lit(False)), F.col("corrected"))
        .otherwise(F.col("original"))
    )
