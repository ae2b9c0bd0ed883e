"""Who spoke: pauses, cues, balance, scores and transcript lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import text
from parlance.functions.rows import explode_rows
from parlance.operators.ordering import Step, prefix

# Pause that switches speakers, and the dominance that forces alternation.
PAUSE_S = 1.5
MIN_CHUNKS, DOMINANCE = 6, 0.85

# Clinician cues (one is listed twice and counts twice), first-person cues
# and the weights of each kind of evidence.
CLINICIAN_CUES = [
    "how are you", "since when", "do you", "are you", "any", "take", "tablet",
    "medicine", "follow up", "next visit", "dose", "symptoms", "diagnosis",
    "तुम्हाला", "तुम्ही", "औषध", "डॉक्टर", "लक्षण", "काय वाटते",
    "आपको", "दवा", "लक्षण", "कैसा", "कब से",
]
FIRST_PERSON_CUES = ["i ", " i'm", " मला", " माझ", "मुझे", " मैं", "mai "]
QUESTION_WEIGHT, CUE_WEIGHT, FIRST_PERSON_WEIGHT, EARLY_WEIGHT = 2.0, 0.8, -0.4, 0.5
RULE_LINE = "─" * 55

CHUNK_ROWS = 65536


def chunk_bucket(order: str = "chunk_id") -> Column:
    return F.floor(F.col(order) / CHUNK_ROWS)


def _letter(flips: Column) -> Column:
    return F.when(F.pmod(flips, F.lit(2)) == 0, "A").otherwise("B")


def _pause(pause_s: float) -> tuple[Column, Step]:
    times = F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    return times, lambda this, prev: F.coalesce(this["start"] - prev["end"] > pause_s, F.lit(False))


def _cue() -> tuple[Column, Step]:
    said = F.struct(
        text.is_question(F.col("text")).alias("asks"), text.is_brief_reply(F.col("text")).alias("brief")
    )
    return said, lambda this, prev: prev["asks"] & this["brief"]


def speaker_by_pause(chunks: DataFrame, pause_s: float = PAUSE_S) -> DataFrame:
    """Speakers A and B change after a pause longer than ``pause_s``."""
    counted = prefix(
        chunks, ["session_id"], ["chunk_id"], chunk_bucket(), step_sum={"_flips": _pause(pause_s)}
    )
    return counted.withColumn("speaker", _letter(F.col("_flips"))).drop("_flips")


def _counted(chunks: DataFrame, pause_s: float = PAUSE_S) -> DataFrame:
    """Position, pauses and cues so far, per chunk."""
    return prefix(
        chunks, ["session_id"], ["chunk_id"], chunk_bucket(), position="_i",
        step_sum={"_pauses": _pause(pause_s), "_cues": _cue()},
    )


def _session_facts(chunks: DataFrame) -> DataFrame:
    """Whether a session has a pause, and a cue among its second and third chunk.

    One row per session comes back; the chunks themselves are not moved for it.
    """
    counted = _counted(chunks.select("session_id", "chunk_id", "start_s", "end_s", "text"))
    return counted.groupBy("session_id").agg(
        (F.max("_pauses") > 0).alias("_paused"),
        F.coalesce(F.max(F.when(F.col("_i") <= 2, F.col("_cues"))) > 0, F.lit(False)).alias("_early"),
    )


def _by_cue() -> Column:
    """Speaker by cues; without an early cue the third chunk switches too."""
    extra = F.when((F.col("_i") >= 2) & ~F.col("_early"), 1).otherwise(0)
    return _letter(F.col("_cues") + extra)


def speaker_by_cue(chunks: DataFrame) -> DataFrame:
    """A question answered briefly changes the speaker.

    The first even position also does when nothing has before it: position 2, unless
    position 1 or 2 is a cue.
    """
    counted = _counted(chunks)
    keep = [c for c in chunks.columns if c != "speaker"]
    return counted.join(_session_facts(chunks), "session_id").withColumn("speaker", _by_cue()).select(
        *keep, "speaker"
    )


def _rebalance(placed: DataFrame) -> DataFrame:
    """Alternate by position ``_i`` where one of A and B holds nearly all chunks."""
    share = placed.groupBy("session_id").agg(
        F.count("*").alias("_n"),
        F.greatest(
            F.count_if(F.col("speaker") == "A"), F.count_if(F.col("speaker") == "B")
        ).alias("_top"),
    )
    lopsided = (F.col("_n") >= MIN_CHUNKS) & (F.col("_top") / F.col("_n") >= DOMINANCE)
    return (
        placed.join(share, "session_id")
        .withColumn("speaker", F.when(lopsided, _letter(F.col("_i"))).otherwise(F.col("speaker")))
        .drop("_i", "_n", "_top")
    )


def speaker_rebalance(chunks: DataFrame) -> DataFrame:
    return _rebalance(prefix(chunks, ["session_id"], ["chunk_id"], chunk_bucket(), position="_i"))


def speaker_hints(chunks: DataFrame) -> DataFrame:
    """Pauses decide; sessions without a pause go by cues; then rebalance."""
    counted = _counted(chunks)
    chosen = F.when(F.col("_paused"), _letter(F.col("_pauses"))).otherwise(_by_cue())
    keep = [c for c in chunks.columns if c != "speaker"]
    labelled = counted.join(_session_facts(chunks), "session_id").withColumn("speaker", chosen)
    return _rebalance(labelled.select(*keep, "speaker", "_i"))


def chunk_score(said: Column, chunk_id: Column) -> tuple[Column, Column]:
    """(has any evidence, score) of one chunk for the clinician role."""
    low = F.lower(F.coalesce(said, F.lit("")))

    def weigh(hit: Column, weight: float) -> tuple[Column, Column]:
        return hit, F.when(hit, weight).otherwise(0.0)

    parts = [weigh(F.contains(low, F.lit("?")), QUESTION_WEIGHT)]
    parts += [weigh(F.contains(low, F.lit(c)), CUE_WEIGHT) for c in CLINICIAN_CUES]
    parts += [weigh(F.contains(low, F.lit(c)), FIRST_PERSON_WEIGHT) for c in FIRST_PERSON_CUES]
    parts.append(weigh(F.coalesce(chunk_id, F.lit(999999)) <= 1, EARLY_WEIGHT))
    found, total = F.lit(False), F.lit(0.0)
    for hit, points in parts:
        found, total = found | hit, total + points
    return found & (low != ""), F.when(low != "", total).otherwise(0.0)


def speaker_scores(chunks: DataFrame) -> DataFrame:
    """Score and first evidence per speaker; speakers without evidence have a NULL score."""
    found, points = chunk_score(F.col("text"), F.col("chunk_id"))
    return (
        chunks.filter(~text.is_blank(F.col("speaker")))
        .withColumn("_found", found)
        .withColumn("_points", points)
        .groupBy("session_id", F.trim("speaker").alias("speaker"))
        .agg(
            F.round(F.sum(F.when(F.col("_found"), F.col("_points"))), 6).alias("score"),
            F.min(F.when(F.col("_found"), F.col("chunk_id"))).alias("first_hit"),
            F.min("chunk_id").alias("first_seen"),
        )
    )


def doctor_speaker(chunks: DataFrame) -> DataFrame:
    """Best-scored speaker per session, earliest evidence first; else the first one seen."""
    rank = F.struct(
        F.col("score").isNotNull(),
        F.col("score"),
        -F.coalesce("first_hit", "first_seen"),
    )
    return (
        speaker_scores(chunks)
        .groupBy("session_id")
        .agg(F.max_by("speaker", rank).alias("doctor_speaker"))
    )


def role_from_speaker(chunks: DataFrame) -> DataFrame:
    """Roles from the inferred clinician; speaker ``A`` is a doctor too."""
    is_doctor = (F.trim("speaker") == F.col("doctor_speaker")) | (F.upper("speaker") == "A")
    return (
        chunks.join(doctor_speaker(chunks), "session_id", "left")
        .filter(~text.is_blank(F.col("text")))
        .withColumn("role", F.when(F.coalesce(is_doctor, F.lit(False)), "Doctor").otherwise("Patient"))
    )


def turn_roles(chunks: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Numbered turns with roles: from the chunks, or line by line where no chunk says anything.

    ``transcripts``: session_id, transcript.
    """
    said = role_from_speaker(chunks)
    placed = prefix(said, ["session_id"], ["chunk_id"], chunk_bucket(), position="_i")
    rest = transcripts.join(said.select("session_id").distinct(), "session_id", "left_anti")
    return placed.select(
        "session_id", (F.col("_i") + 1).cast("long").alias("turn_id"), "role", "text"
    ).unionByName(roles_by_line(rest).withColumn("turn_id", F.col("turn_id").cast("long")))


def roles_by_line(transcripts: DataFrame, key: str = "session_id") -> DataFrame:
    """Alternate roles over the non-empty lines of a transcript without chunks."""
    lines = F.filter(F.transform(F.split("transcript", text.LINE_END), text.strip), lambda x: x != "")
    return explode_rows(transcripts, [key], lines, "text", "_i").select(
        key,
        (F.col("_i") + 1).alias("turn_id"),
        F.when(F.col("_i") % 2 == 0, "Doctor").otherwise("Patient").alias("role"),
        "text",
    )


def format_transcript(chunks: DataFrame) -> DataFrame:
    """Transcript lines: a time stamp each, a heading where the speaker changes.

    One row per chunk, in chunk order, so a long session is never one string.
    """
    back = prefix(
        chunks, ["session_id"], ["chunk_id"], chunk_bucket(), lag={"_prev": F.col("speaker")}
    )
    speaker = F.coalesce("speaker", F.lit(""))
    changes = (speaker != "") & ~F.col("_prev").eqNullSafe(F.col("speaker"))
    stamp = F.format_string(
        "[%02d:%02d]", F.floor(F.col("start_s") / 60), F.floor(F.col("start_s") % 60)
    )
    return back.select(
        "session_id", "chunk_id",
        F.when(changes, F.concat(F.lit(f"\n{RULE_LINE}\nSpeaker "), speaker, F.lit(":")))
        .alias("heading"),
        F.concat(F.lit("  "), stamp, F.lit("  "), F.col("text")).alias("line"),
    )


def segment_lines(chunks: DataFrame) -> DataFrame:
    """``[ start s - end s] speaker: text`` lines."""
    return chunks.select(
        "session_id", "chunk_id",
        F.format_string("[%6.2fs - %6.2fs] %s: %s", "start_s", "end_s", "speaker", "text")
        .alias("line"),
    )
