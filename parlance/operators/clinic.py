"""Patients and visits: lists, searches, counts and rejected records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of list requests and the activity window.
MAX_PATIENTS, MAX_VISITS, ACTIVE_DAYS = 200, 500, 7


def clamp(limit: int, top: int) -> int:
    return max(1, min(limit, top))


def visit_counts(patients: DataFrame, visits: DataFrame) -> DataFrame:
    """Patients with their number of visits; visits are counted before the join."""
    counts = visits.groupBy("patient_id").agg(F.count("*").alias("session_count"))
    return patients.join(counts, patients["id"] == counts["patient_id"], "left").select(
        *[patients[c] for c in patients.columns],
        F.coalesce("session_count", F.lit(0)).alias("session_count"),
    )


def search_patients(patients: DataFrame, visits: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Newest patients whose name holds ``query``; ``%`` and ``_`` in it are wildcards."""
    found = (
        patients.filter(F.col("full_name").ilike(f"%{query.strip()}%"))
        .orderBy(F.col("created_at").desc(), F.col("id"))
        .limit(clamp(limit, MAX_PATIENTS))
    )
    mine = visits.join(found.select(F.col("id").alias("patient_id")), "patient_id", "left_semi")
    return visit_counts(found, mine)


def visits_of_patient(visits: DataFrame, patients: DataFrame, patient_id: int | None = None) -> DataFrame:
    """Visits with the patient's name, for one patient or all."""
    names = patients.select(F.col("id").alias("patient_id"), F.col("full_name").alias("patient_name"))
    if patient_id is not None:
        visits = visits.filter(F.col("patient_id") == patient_id)
        names = names.filter(F.col("patient_id") == patient_id)
    return visits.join(names, "patient_id")


def patient_visits(visits: DataFrame, patients: DataFrame, patient_id: int | Column, limit: int | None = 100) -> DataFrame:
    """Visits of one patient, newest first; no limit with ``None``."""
    mine = visits.filter(F.col("patient_id") == patient_id)
    rows = visits_of_patient(mine, patients).orderBy(F.col("created_at").desc(), F.col("visit_id"))
    return rows if limit is None else rows.limit(clamp(limit, MAX_VISITS))


def recent_visits(visits: DataFrame, patients: DataFrame, limit: int = 100) -> DataFrame:
    """Newest visits of known patients first."""
    n = clamp(limit, MAX_VISITS)
    return (
        visits_of_patient(visits, patients)
        .orderBy(F.col("created_at").desc(), F.col("visit_id"))
        .limit(n)
    )


def fk_violations(visits: DataFrame, patients: DataFrame) -> DataFrame:
    return visits.join(patients.select(F.col("id").alias("patient_id")), "patient_id", "left_anti")


def clinic_stats(patients: DataFrame, visits: DataFrame, now: Column) -> DataFrame:
    """Patients, visits, and visits of the last seven days before ``now``."""
    v = visits.agg(
        F.count("*").alias("total_sessions"),
        F.count_if(F.col("created_at") >= now - F.expr(f"INTERVAL {ACTIVE_DAYS} DAYS"))
        .alias("active_sessions_last_7_days"),
    )
    p = patients.agg(F.count("*").alias("total_patients"))
    return v.withColumn("total_patients", p.scalar())


def decode_payload(c: Column, schema: str) -> Column:
    """JSON text as a struct; missing or broken text gives a struct of NULLs."""
    return F.from_json(F.coalesce(F.nullif(c, F.lit("")), F.lit("{}")), schema)


def quarantine(records: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason)."""
    marked = records.withColumn("reject_reason", reason)
    return (
        marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        marked.filter(F.col("reject_reason").isNotNull()),
    )
