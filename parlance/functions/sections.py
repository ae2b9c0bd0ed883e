"""Four-section notes: splitting, cleaning, sub-headings, prompts.

Each function rewrites one text inside its row; lines never leave the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import LINE_END, NOT_KEPT, WS, is_blank, let, squeeze, strip

SECTIONS = ["subjective", "objective", "assessment", "plan"]
NOTE_TYPE = "struct<subjective:string,objective:string,assessment:string,plan:string>"

# What marks a section line, and the text for an empty section.
SECTION_MARKS = {
    "subjective": ["subjective", "विषय", "व्यक्तिनिष्ठ", "s:"],
    "objective": ["objective", "उद्देश", "वस्तुनिष्ठ", "o:"],
    "assessment": ["assessment", "मूल्यांकन", "a:"],
    "plan": ["plan", "योजना", "p:"],
}
SHORT_HEADERS = {
    "subjective": rf"^{WS}*(?:s|subj){WS}*[:\-]{WS}*$",
    "objective": rf"^{WS}*(?:o|obj){WS}*[:\-]{WS}*$",
    "assessment": rf"^{WS}*(?:a|assess?){WS}*[:\-]{WS}*$",
    "plan": rf"^{WS}*(?:p|pln){WS}*[:\-]{WS}*$",
}
EMPTY_SECTION = "- Not clearly elicited from interview."
TRIM_NOTE = "\n...[trimmed for length]...\n"
FALLBACK_HEADING = "Key Clinical Points"
PROMPT_CHARS = 7000

# Prompt wording for the two kinds of training example.
INTERVIEW_PROMPT = (
    "You are a clinical psychologist. Generate a comprehensive SOAP note from this mental "
    "health interview conversation.\n\n"
    "SOAP Format:\n"
    "- SUBJECTIVE: Patient's reported symptoms, feelings, and concerns\n"
    "- OBJECTIVE: Clinician's observations of appearance, behavior, mood, affect\n"
    "- ASSESSMENT: Clinical diagnosis, PHQ-8 score, risk assessment\n"
    "- PLAN: Treatment recommendations, medications, follow-up, safety planning\n\n"
    "Conversation:\n%s\n\nPHQ-8 Score: %s\n\nGenerate the SOAP note:"
)
REVIEWED_PROMPT = (
    "Generate a SOAP note in Marathi for this therapy session.\n\n"
    "**Conversation:**\n%s\n\n**Extracted Entities:**%s\n\n"
    "**PHQ-8 Score:** %s (%s depression)\n\nGenerate a professional SOAP note in Marathi:"
)
REVIEWED_RESPONSE = (
    "**Subjective (विषयनिष्ठ):**\n%s\n\n**Objective (वस्तुनिष्ठ):**\n%s\n\n"
    "**Assessment (मूल्यांकन):**\n%s\n\n**Plan (योजना):**\n%s"
)


def header(name: str) -> str:
    return rf"(?:\*\*)?{WS}*{name}{WS}*:?{WS}*(?:\*\*)?"


def lines_of(text: Column, ends: str = LINE_END) -> Column:
    """Stripped lines that are not empty; ``ends`` is what separates them."""
    return F.filter(F.transform(F.split(text, ends), strip), lambda x: x != "")


def first_by_key(items: Column) -> Column:
    """Keep the first ``v`` of each ``k`` of array<struct<k,i,v>>, in ``i`` order."""

    def dedupe(s: Column) -> Column:
        firsts = F.filter(s, lambda x, j: (j == 0) | (x["k"] != F.get(s, j - 1)["k"]))
        ordered = F.array_sort(
            F.transform(firsts, lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))
        )
        return F.transform(ordered, lambda x: x["v"])

    return let(F.array_sort(items), dedupe)


def sanitise_section(text: Column) -> Column:
    """One clinical point per line, headings kept, repeated lines dropped."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), rf"{WS}*#{{3,}}{WS}*", "\n")
    out = F.regexp_replace(out, rf"{WS}+[•●]{WS}*", "\n- ")

    def bare(line: Column) -> Column:
        return F.btrim(F.lower(line), F.lit("*: "))

    kept = F.filter(
        lines_of(out),
        lambda x: ~bare(x).isin(SECTIONS) & ~F.startswith(bare(x), F.lit("```")),
    )

    def point(line: Column) -> Column:
        body = strip(F.regexp_replace(line, rf"^#{{1,6}}{WS}*", ""))
        return let(
            body,
            lambda b: F.when(
                F.startswith(b, F.lit("-")),
                F.concat(F.lit("- "), strip(F.ltrim(b, F.lit("-")))),
            )
            .when(b.rlike(r"^[ऀ-ॿA-Za-z][^\n]{2,120}:$"), b)
            .otherwise(F.concat(F.lit("- "), b)),
        )

    keyed = F.transform(
        F.transform(kept, point),
        lambda x, i: F.struct(
            F.regexp_replace(F.lower(x), rf"{WS}+", " ").alias("k"), i.alias("i"), x.alias("v")
        ),
    )
    return strip(F.array_join(first_by_key(keyed), "\n"))


def named(texts: Column) -> Column:
    """Note struct out of an array with one text per section."""
    return let(
        texts,
        lambda a: F.struct(*[F.get(a, i).alias(name) for i, name in enumerate(SECTIONS)]),
    ).cast(NOTE_TYPE)


def collect_sections(
    lines: Column, section_of: Callable[[Column], Column], finish: Callable[[Column], Column]
) -> Column:
    """struct of four texts: the non-header lines that follow each section's headers."""

    def gather(b: Column) -> Column:
        body, marks = b["lines"], b["marks"]
        n = F.size(body)
        heads = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.get(marks, i).isNotNull(),
        )

        def blocks_of(h: Column) -> Column:
            blocks = F.transform(
                h,
                lambda at, j: F.struct(
                    F.get(marks, at).alias("name"),
                    F.slice(body, at + 2, F.coalesce(F.get(h, j + 1), n) - at - 1).alias("lines"),
                ),
            )

            def section(x: Column, name: Column) -> Column:
                mine = F.filter(x, lambda s: s["name"] == name)
                return finish(
                    F.array_join(F.flatten(F.transform(mine, lambda s: s["lines"])), "\n")
                )

            names = F.array(*[F.lit(name) for name in SECTIONS])
            return let(blocks, lambda x: F.transform(names, lambda name: section(x, name)))

        return let(heads, blocks_of)

    bound = let(
        lines,
        lambda x: F.struct(x.alias("lines"), F.transform(x, section_of).alias("marks")),
    )
    return named(let(bound, gather))


def split_sections_simple(text: Column) -> Column:
    """A line that holds any marker opens that section; other lines belong to it."""

    def section_of(line: Column) -> Column:
        low, out = F.lower(line), None
        for name in SECTIONS:
            hit = F.lit(False)
            for mark in SECTION_MARKS[name]:
                hit = hit | F.contains(low, F.lit(mark))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out

    return collect_sections(lines_of(text, "\n"), section_of, strip)


def split_sections_by_line(text: Column) -> Column:
    """Header lines, long or short, open a section; each section is sanitised."""

    def section_of(line: Column) -> Column:
        out = None
        for name in SECTIONS:
            hit = line.rlike(f"(?i)^{header(name)}")
            out = F.when(hit, name) if out is None else out.when(hit, name)
        for name in SECTIONS:
            out = out.when(line.rlike(f"(?i){SHORT_HEADERS[name]}"), name)
        return out

    return collect_sections(lines_of(text), section_of, sanitise_section)


def split_sections_by_offset(text: Column) -> Column:
    """Cut at the first mention of each section name; NULL when none is mentioned."""

    def cut(marks: Column) -> Column:
        def chunk(name: str) -> Column:
            at = F.filter(marks, lambda m: m["name"] == name)
            start = F.get(at, 0)["start"]
            later = F.filter(marks, lambda m: m["start"] > start)
            stop = F.coalesce(F.array_min(F.transform(later, lambda m: m["start"])),
                              F.length(text) + 1)
            body = F.regexp_replace(
                F.substring(text, start, stop - start),
                rf"(?i)^(?:\*\*)?{WS}*{name}{WS}*:?{WS}*(?:\*\*)?{WS}*", "",
            )
            return F.when(F.size(at) > 0, body).otherwise("")

        return F.when(F.size(marks) > 0, F.array(*[chunk(name) for name in SECTIONS]))

    low = F.lower(text)
    found = F.array(
        *[
            F.struct(F.regexp_instr(low, F.lit(header(name))).alias("start"),
                     F.lit(name).alias("name"))
            for name in SECTIONS
        ]
    )
    chunks = let(F.array_sort(F.filter(found, lambda m: m["start"] > 0)), cut)
    return let(chunks, lambda c: F.when(c.isNotNull(), named(F.transform(c, sanitise_section))))


def split_sections_json(text: Column) -> Column:
    """Sections of a JSON object inside the text; NULL when there is none."""
    body = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    # A tail behind the object makes the whole slice no JSON.
    parsed = F.when(
        F.try_parse_json(body).isNotNull(), F.from_json(body, "map<string,string>")
    )

    def pick(m: Column) -> Column:
        known = F.lit(False)
        for name in SECTIONS:
            known = known | F.map_contains_key(m, name)
        texts = F.array(*[F.coalesce(F.element_at(m, name), F.lit("")) for name in SECTIONS])
        return F.when(known, named(F.transform(texts, sanitise_section)))

    return F.when(body != "", let(parsed, pick)).cast(NOTE_TYPE)


def split_sections_robust(text: Column) -> Column:
    """JSON, else header offsets, else line headers, else everything in the first section."""
    text = F.coalesce(text, F.lit(""))

    def merge(b: Column) -> Column:
        first, by_line = b["first"], b["by_line"]
        filled = {
            name: F.when(is_blank(first[name]), by_line[name]).otherwise(first[name])
            for name in SECTIONS
        }
        nothing = F.lit(True)
        for c in filled.values():
            nothing = nothing & is_blank(c)
        filled["subjective"] = F.when(nothing, sanitise_section(text)).otherwise(
            filled["subjective"]
        )
        return F.struct(
            *[
                F.when(is_blank(c), EMPTY_SECTION).otherwise(c).alias(name)
                for name, c in filled.items()
            ]
        )

    def or_default(j: Column) -> Column:
        return F.struct(
            *[
                F.when(is_blank(j[name]), EMPTY_SECTION).otherwise(j[name]).alias(name)
                for name in SECTIONS
            ]
        )

    by_text = let(
        F.struct(
            split_sections_by_line(text).alias("by_line"),
            split_sections_by_offset(text).alias("by_offset"),
        ),
        lambda b: let(
            F.struct(
                b["by_line"].alias("by_line"),
                F.coalesce(b["by_offset"], b["by_line"]).alias("first"),
            ),
            merge,
        ),
    )
    return (
        F.when(
            text == "",
            F.struct(*[F.lit("").alias(name) for name in SECTIONS]).cast(NOTE_TYPE),
        )
        .otherwise(
            let(
                split_sections_json(text),
                lambda j: F.when(j.isNotNull(), or_default(j)).otherwise(by_text),
            )
        )
        .cast(NOTE_TYPE)
    )


def prepare_conversation(text: Column, max_chars: int = PROMPT_CHARS) -> Column:
    """Squeezed lines without near-empty turns or immediate repeats, cut head and tail."""

    def tidy(line: Column) -> Column:
        at = F.instr(line, ":")
        # Squeezed lines hold no other blanks than plain ones.
        said = F.trim(F.substring(line, at + 1, F.length(line)))
        return F.when(at == 0, line).when(
            F.length(said) >= 2,
            F.concat(F.trim(F.substring(line, F.lit(1), at - 1)), F.lit(": "), said),
        )

    lines = F.filter(F.transform(F.split(text, LINE_END), squeeze), lambda x: x != "")
    kept = F.filter(F.transform(lines, tidy), lambda x: x.isNotNull())
    keyed = F.transform(
        kept,
        lambda x: F.struct(
            x.alias("line"),
            F.regexp_replace(F.lower(x), f"[{NOT_KEPT}]+", "").alias("key"),
        ),
    )
    merged = let(
        keyed,
        lambda k: F.array_join(
            F.transform(
                F.filter(
                    k,
                    lambda x, i: x["key"]
                    != F.when(i == 0, F.lit("")).otherwise(F.get(k, i - 1)["key"]),
                ),
                lambda x: x["line"],
            ),
            "\n",
        ),
    )
    half = max_chars // 2
    return let(
        merged,
        lambda m: F.when(
            F.length(m) > max_chars,
            F.concat(F.left(m, F.lit(half)), F.lit(TRIM_NOTE), F.right(m, F.lit(half))),
        ).otherwise(m),
    )


def subsections(text: Column) -> Column:
    """array<struct<title, points>>: headings ending in ':' and the points under them."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "\n")
    t = F.regexp_replace(t, rf"{WS}*#{{1,6}}{WS}*", "\n")
    t = F.regexp_replace(t, rf"{WS}+([^:\n-][^:\n]{{2,110}}:){WS}*-{WS}+", "\n$1\n- ")
    t = F.regexp_replace(t, rf"{WS}+-{WS}+", "\n- ")

    def group(lines: Column) -> Column:
        n = F.size(lines)
        heads = F.filter(
            F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")),
            lambda i: F.get(lines, i).rlike(r"^[^:\n-][^:\n]{2,120}:$"),
        )

        def point(x: Column) -> Column:
            return strip(F.regexp_replace(x, rf"^-+{WS}*", ""))

        def blocks(h: Column) -> Column:
            made = F.transform(
                h,
                lambda at, j: F.struct(
                    F.when(at < 0, FALLBACK_HEADING)
                    .otherwise(F.regexp_replace(F.get(lines, at), ":$", "")).alias("title"),
                    F.filter(
                        F.transform(
                            F.slice(lines, at + 2, F.coalesce(F.get(h, j + 1), n) - at - 1), point
                        ),
                        lambda p: p != "",
                    ).alias("points"),
                ),
            )
            return F.filter(made, lambda s: F.size(s["points"]) > 0)

        return let(F.array_insert(heads, 1, F.lit(-1)), blocks)

    return let(lines_of(t, "\n"), group)


def key_points(subs: Column, n: int = 3) -> Column:
    return F.slice(F.flatten(F.transform(subs, lambda s: s["points"])), 1, n)


def has_content(note: Column) -> Column:
    hit = F.lit(False)
    for name in SECTIONS:
        hit = hit | ~is_blank(note[name])
    return hit


def interview_prompt(conversation: Column, score: Column) -> Column:
    return F.format_string(INTERVIEW_PROMPT, conversation, score.cast("string"))


def reviewed_prompt(conversation: Column, entities: Column, score: Column, severity: Column) -> Column:
    listed = F.when(F.coalesce(entities, F.lit("")) == "", " None").otherwise(
        F.concat(F.lit("\n"), entities)
    )
    return F.format_string(REVIEWED_PROMPT, conversation, listed, score.cast("string"), severity)


def reviewed_response(note: Column) -> Column:
    return F.format_string(
        REVIEWED_RESPONSE, *[F.coalesce(note[name], F.lit("N/A")) for name in SECTIONS]
    )


def strip_fence(reply: Column) -> Column:
    """The body of a fenced block, or the whole reply."""
    t = strip(reply)
    tagged = F.regexp_extract(t, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(t, r"(?s)```(.*?)(?:```|$)", 1)
    return F.when(F.contains(t, F.lit("```json")), strip(tagged)).when(
        F.contains(t, F.lit("```")), strip(plain)
    ).otherwise(t)
