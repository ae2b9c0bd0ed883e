"""Clinical entities in turns: extraction, first occurrences, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions import scores, spans
from parlance.functions.rows import explode_rows, inline_rows
from parlance.functions.text import let
from parlance.operators.ordering import head_rows

# How many entities a note keeps and how many a label lists.
NOTE_ENTITIES, LISTED_PER_LABEL = 15, 8
LISTED_LABELS = ["SYMPTOM", "EMOTION", "PERSON", "LOCATION"]
NO_ENTITIES = "No specific medical entities extracted."


def _spread(df: DataFrame, found: Column, source: str) -> DataFrame:
    hit = F.col("_hit")
    marked = let(found, lambda s: spans.with_entities(F.col(source), s))
    return explode_rows(df, [F.col(c) for c in df.columns], marked, "_hit").select(
        *df.columns, hit["entity"].alias("entity"), hit["label"].alias("label"),
        hit["start"].alias("start"), hit["stop"].alias("stop"),
        hit["confidence"].alias("confidence"), hit["rule"].alias("rule"),
    )


def keyword_entities(
    turns: DataFrame, source: str = "text", keywords: dict[str, list[str]] = spans.KEYWORDS
) -> DataFrame:
    """Every keyword occurrence, overlapping ones too, with its offsets."""
    return _spread(turns, spans.keyword_spans(F.col(source), keywords), source)


def indic_entities(turns: DataFrame, source: str = "text") -> DataFrame:
    """Keyword occurrences by the list for Indian languages."""
    return keyword_entities(turns, source, spans.INDIC_KEYWORDS)


def pattern_entities(
    turns: DataFrame, source: str = "text", patterns: dict[str, list[str]] = spans.PATTERNS
) -> DataFrame:
    """Non-overlapping matches of each pattern, with their offsets."""
    return _spread(turns, spans.pattern_spans(F.col(source), patterns), source)


def rule_entities(turns: DataFrame, source: str = "text") -> DataFrame:
    """Keyword hits, then pattern hits, in one pass over the text."""
    found = F.concat(
        spans.keyword_spans(F.col(source), spans.KEYWORDS),
        F.transform(
            spans.pattern_spans(F.col(source)),
            lambda s: s.withField("rule", s["rule"] + len(spans.flat_rules(spans.KEYWORDS))),
        ),
    )
    return _spread(turns, found, source)


def dedupe(entities: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First entity per (keys, lower-cased text, label), combined before the shuffle."""
    rest = [c for c in entities.columns if c not in {*keys, "label"}]
    return (
        entities.groupBy(*keys, "label", F.lower("entity").alias("entity_key"))
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"))
        .select(*keys, "label", "entity_key", "first.*")
    )


def by_side(turns: DataFrame) -> DataFrame:
    """Entities of patient and doctor from the native and the English text of each turn."""
    both = F.array(
        F.struct(F.lit("marathi").alias("source"), F.col("text").alias("said")),
        F.struct(F.lit("english").alias("source"), F.col("text_en").alias("said")),
    )
    said = inline_rows(
        turns, ["session_id", "turn_id", scores.side_of(F.col("role")).alias("side")], both
    )
    found = rule_entities(said, "said").drop("said")
    firsts = dedupe(found, ["session_id", "turn_id", "side", "source"], ["rule", "start"])
    return firsts.withColumn(
        "entity", F.concat("entity", F.lit(" ["), F.col("source"), F.lit("]"))
    )


def summary(entities: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Distinct texts per label with the place each was first seen."""
    firsts = dedupe(entities, keys, order)
    return firsts.select(*keys, "label", "entity", *order)


def keyword_context(turns: DataFrame, source: str = "text") -> DataFrame:
    """First hit of each symptom word with its surroundings, then emotion words not yet seen."""
    low = F.lower(source)
    rows = []
    for i, word in enumerate(spans.SYMPTOM_WORDS):
        at = F.instr(low, word) - 1
        lo = F.greatest(at - spans.CONTEXT_CHARS, F.lit(0))
        hi = at + len(word) + spans.CONTEXT_CHARS
        rows.append(
            F.when(
                F.contains(low, F.lit(word)),
                F.struct(
                    F.lit(i).alias("rule"), F.lit(word).alias("entity"),
                    F.lit("SYMPTOM").alias("label"), F.lit(spans.SYMPTOM_SCORE).alias("score"),
                    F.btrim(F.substring(source, lo + 1, hi - lo)).alias("context"),
                ),
            )
        )
    for i, word in enumerate(spans.EMOTION_WORDS, len(spans.SYMPTOM_WORDS)):
        if word in spans.SYMPTOM_WORDS:
            continue
        rows.append(
            F.when(
                F.contains(low, F.lit(word)),
                F.struct(
                    F.lit(i).alias("rule"), F.lit(word).alias("entity"),
                    F.lit("EMOTION").alias("label"), F.lit(spans.EMOTION_SCORE).alias("score"),
                    F.lit("").alias("context"),
                ),
            )
        )
    keep = [c for c in turns.columns if c != source]
    return (
        inline_rows(turns, keep, F.array_compact(F.array(*rows)))
    )


def top_entities(entities: DataFrame, keys: list[str], n: int = NOTE_ENTITIES) -> DataFrame:
    """Highest-scored distinct entities per note, list order on ties."""
    firsts = dedupe(entities, keys, ["rule"])
    return head_rows(firsts, keys, [F.col("score").desc(), F.col("rule").asc()], n)


def entity_block(entities: DataFrame, keys: list[str], notes: DataFrame) -> DataFrame:
    """Text block per note: up to eight entries under each label heading, or a line that
    says there are none."""
    top = top_entities(entities, keys)
    listed = head_rows(top, [*keys, "label"], [F.col("score").desc(), F.col("rule").asc()],
                       LISTED_PER_LABEL)
    rank = F.array_position(F.array(*[F.lit(x) for x in LISTED_LABELS]), F.col("label"))
    item = F.concat(
        F.lit("  - "), F.col("entity"),
        F.when(F.col("context") != "", F.concat(F.lit(': "'), "context", F.lit('"'))).otherwise(""),
    )
    blocks = (
        listed.filter(rank > 0)
        .groupBy(*keys, "label")
        .agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("score")).alias("s"), "rule", item.alias("t")))
            ).alias("items")
        )
    )
    body = F.concat(
        F.lit("\n**"), F.col("label"), F.lit("S:**\n"),
        F.array_join(F.transform("items", lambda x: x["t"]), "\n"),
    )
    made = (
        blocks.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), body.alias("b")))).alias("x"))
        .select(*keys, F.array_join(F.transform("x", lambda x: x["b"]), "\n").alias("block"))
    )
    return notes.select(*keys).distinct().join(made, keys, "left").fillna(NO_ENTITIES, ["block"])
