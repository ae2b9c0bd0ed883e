"""Scores, codes and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper bounds of the depression bands and their label sets.
BAND_LIMITS = [4, 9, 14, 19]
BAND_NAMES = ["minimal", "mild", "moderate", "moderately_severe", "severe"]
BAND_TITLES = ["Minimal/None", "Mild", "Moderate", "Moderately Severe", "Severe"]
STRATA = ["minimal", "mild", "moderate", "severe", "severe"]
EXPECTED_WORDS = ["minimal", "mild", "moderate", "moderately severe", "moderately severe"]

# Speakers taken as clinicians in interview transcripts.
CLINICIANS = ["ellie", "doctor", "interviewer"]

# Error-rate bands (percent).
WER_LIMITS = [10.0, 20.0, 30.0]
WER_NAMES = ["excellent", "good", "fair", "poor"]

# Words that tell the two sides of a conversation apart.
PATIENT_WORDS = ["patient", "रुग्ण"]
CLINICIAN_WORDS = ["therapist", "doctor", "थेरपिस्ट"]

# Limits for records accepted by the clinic store.
SOURCE_TYPES = ["json", "audio", "transcript"]
AUDIO_SUFFIXES = [".wav", ".mp3", ".m4a", ".flac", ".ogg"]
AGE_RANGE = (0, 130)


def band(score: Column, names: list[str] = BAND_NAMES, unknown: str | None = "unknown") -> Column:
    """Five-band label of a score; NULL gives ``unknown``."""
    out = F.when(score.isNull(), F.lit(unknown))
    for limit, name in zip(BAND_LIMITS, names):
        out = out.when(score <= limit, name)
    return out.otherwise(names[-1])


def role_of(speaker: Column, clinicians: list[str] = CLINICIANS) -> Column:
    return F.when(F.lower(F.trim(speaker)).isin(clinicians), "Doctor").otherwise("Patient")


def side_of(role: Column) -> Column:
    low = F.lower(F.coalesce(role, F.lit("")))

    def has_any(marks: list[str]) -> Column:
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(low, F.lit(m))
        return hit

    return (
        F.when(has_any(PATIENT_WORDS), "patient")
        .when(has_any(CLINICIAN_WORDS), "doctor")
        .otherwise("patient")
    )


def int_of(text: Column) -> Column:
    """Whole number held in text, NULL when empty or malformed."""
    return F.btrim(text).try_cast("int")


def score_of(first: Column, second: Column) -> Column:
    """First non-empty of two texts, read as a number and cut to its whole part."""
    text = F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))
    return text.try_cast("double").cast("int")


def gender_label(code: Column, codes: dict[int, str]) -> Column:
    out = F.lit(None).cast("string")
    for value, name in codes.items():
        out = F.when(code == value, name).otherwise(out)
    return out


def seconds_between(start: Column, stop: Column) -> Column:
    return F.bround(F.greatest(stop - start, F.lit(0.0)), 3)


def rate_wer(wer: Column) -> Column:
    out = F.when(wer < WER_LIMITS[0], WER_NAMES[0])
    for limit, name in zip(WER_LIMITS[1:], WER_NAMES[1:]):
        out = out.when(wer <= limit, name)
    return out.otherwise(WER_NAMES[-1])


def real_time_factor(processing_s: Column, duration_s: Column, floor: float = 1e-6) -> Column:
    return processing_s / F.greatest(duration_s, F.lit(floor))


def patient_reject_reason(name: Column, age: Column) -> Column:
    """NULL when the patient record is acceptable."""
    return F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "full_name is required").when(
        (age < AGE_RANGE[0]) | (age > AGE_RANGE[1]), "age must be between 0 and 130"
    )


def visit_reject_reason(source_type: Column, file_name: Column) -> Column:
    suffix = F.lower(F.regexp_extract(file_name, r"(\.[^./]*)$", 1))
    return F.when(~F.coalesce(source_type, F.lit("")).isin(SOURCE_TYPES), "bad source_type").when(
        (source_type == "audio") & ~suffix.isin(AUDIO_SUFFIXES), "unsupported audio format"
    )


def session_id_from_path(path: Column) -> Column:
    """Whole number before the first underscore of the file stem, else NULL."""
    stem = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.split(F.regexp_replace(stem, r"\.[^.]*$", ""), "_")[0].try_cast("long")
