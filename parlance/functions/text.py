"""Text columns: tokens, scripts, language, cleaning, transcript cues.

Everything here works inside one row, so no function causes a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.arrays import let

# The white space of Unicode, as characters and as a class that Java and RE2
# read alike, and the ends of a line.
BLANK_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
BLANKS = "".join(chr(c) for a, b in BLANK_RANGES for c in range(a, b + 1))
WS = "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in BLANK_RANGES) + "]"
# Blanks that are more than one plain one, in Java's own terms: it tests one property, not ten ranges.
ANY_BLANK = r"\s\x1C-\x1F"
ODD_BLANKS = f"(?U) [{ANY_BLANK}]+|[{ANY_BLANK}&&[^ ]][{ANY_BLANK}]*"
LINE_END = r"\r\n|[\n\x{0b}\x{0c}\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"

# Question cues, brief-reply openers and length of a brief reply.
QUESTION_CUES = [
    "what", "why", "when", "where", "who", "how", "can you", "do you",
    "did you", "are you", "could you", "would you", "tell me",
]
REPLY_OPENERS = ["yes", "no", "hmm", "okay", "ok", "right", "yeah", "i "]
BRIEF_REPLY_WORDS = 14

# Transcript length limits for speech clips.
CLIP_TEXT_MIN, CLIP_TEXT_MAX = 3, 500


# All characters but 0-9, a-z, Devanagari and the blank. Spelt out, the class matches
# several times faster than the negated one.
NOT_KEPT = r"\x00-\x1F!-/:-`{-\x{8FF}\x{980}-\x{10FFFF}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def or_else(c: Column, other: Column) -> Column:
    """``c`` unless it is NULL or the empty string."""
    return F.coalesce(F.nullif(c, F.lit("")), other)


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, ODD_BLANKS, " "))


def normalise(c: Column) -> Column:
    """Lower-case letters and digits (Latin and Devanagari), single spaces."""
    kept = F.regexp_replace(F.lower(c), f"[{NOT_KEPT} ]+", " ")
    return F.coalesce(F.btrim(kept), F.lit(""))


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalise(c), " "), lambda w: w != "")


def spoken_tokens(c: Column) -> Column:
    """Lower-case runs of letters, digits, underscore and apostrophe."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_']+)"), F.lit(1))


def chars_in(c: Column, char_class: str) -> Column:
    """Number of characters of ``c`` inside a regex character class body."""
    return F.length(F.regexp_replace(c, f"[^{char_class}]+", ""))


def detect_language(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    total = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(text == "", "english")
        .when(
            chars_in(text, r"ऀ-ॿ") / total > 0.3,
            F.when(F.contains(text, F.lit("ळ")) | F.contains(text, F.lit("ऱ")), "marathi")
            .otherwise("hindi"),
        )
        .when(chars_in(text, "A-z") / total > 0.5, "english")
        .otherwise("mixed")
    )


def latin_ratio(c: Column) -> Column:
    """Share of characters below code point 128."""
    return chars_in(c, r"\x00-\x7F") / F.greatest(F.length(c), F.lit(1))


def mostly_english(c: Column) -> Column:
    return latin_ratio(c) > 0.7


def is_question(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    hit = F.contains(t, F.lit("?"))
    for cue in QUESTION_CUES:
        hit = hit | F.contains(t, F.lit(cue))
    return hit


def is_brief_reply(c: Column) -> Column:
    t = strip(F.lower(F.coalesce(c, F.lit(""))))
    hit = word_count(t) <= BRIEF_REPLY_WORDS
    for opener in REPLY_OPENERS:
        hit = hit | F.startswith(t, F.lit(opener))
    return hit


def valid_clip_text(c: Column) -> Column:
    n = F.length(strip(c))
    return F.coalesce((n >= CLIP_TEXT_MIN) & (n <= CLIP_TEXT_MAX), F.lit(False))


def clean_asr_text(c: Column) -> Column:
    """Collapse stuck characters, stuck words and stuck short phrases."""
    # Run lengths at which a repeat counts as stuck (8, 6, 4).
    word = r"[\p{L}\p{N}_']+"
    out = strip(F.coalesce(c, F.lit("")))
    out = F.regexp_replace(out, r"(.)\1{7,}", "$1$1$1")
    out = F.regexp_replace(out, rf"(?iU)\b({word})(?:{WS}+\1){{5,}}\b", "$1")
    out = F.regexp_replace(out, rf"(?iU)\b({word}(?:{WS}+{word}){{1,3}})(?:{WS}+\1){{3,}}\b", "$1")
    return squeeze(out)


def collapse_loops(c: Column) -> Column:
    """Drop noise runs, an exact second half, and looping 3-6 word openings."""
    cleaned = strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"([.·•\\-]{WS}*){{6,}}", ""))
    cleaned = strip(F.regexp_replace(cleaned, f"{WS}{{2,}}", " "))

    def shorten(b: Column) -> Column:
        text, w = b["text"], b["w"]
        n = F.size(w)
        half = F.floor(n / 2).cast("int")
        out = F.when(n < 6, text).when(
            F.slice(w, F.lit(1), half) == F.slice(w, half + 1, half),
            F.array_join(F.slice(w, F.lit(1), half), " "),
        )
        for size in (3, 4, 5, 6):
            head = F.slice(w, 1, size)
            same = F.lit(True)
            for k in (1, 2, 3):
                same = same & (F.slice(w, 1 + k * size, size) == head)
            out = out.when((n >= 4 * size) & same, F.array_join(head, " "))
        return out.otherwise(text)

    return let(F.struct(cleaned.alias("text"), words(cleaned).alias("w")), shorten)


def longest_run(items: Column) -> Column:
    """Length of the longest stretch of equal neighbours in an array of strings."""
    start = F.struct(F.lit("").alias("prev"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when((acc["run"] > 0) & (x == acc["prev"]), acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(
            x.alias("prev"), run.alias("run"), F.greatest(acc["best"], run).alias("best")
        )

    return F.aggregate(items, start, step, lambda acc: acc["best"])


# Seven equal tokens in a row, in tokens joined by blanks.
STUCK = r"(?:^| )([^ ]++)(?: \1){6}(?: |$)"


def is_low_info(c: Column) -> Column:
    """No tokens, or at least eight with a run of seven or under 20 % distinct."""

    def judge(t: Column) -> Column:
        n = F.size(t)
        return (
            F.when(n == 0, F.lit(True))
            .when(n < 8, F.lit(False))
            .otherwise((F.size(F.array_distinct(t)) / n < 0.2) | F.rlike(F.array_join(t, " "), F.lit(STUCK)))
        )

    return let(spoken_tokens(F.coalesce(c, F.lit(""))), judge)


def pack_pieces(c: Column, separator: str, limit: int, glue: str) -> Column:
    """Greedily pack separator-split pieces into chunks of about ``limit`` characters."""
    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("cur")
    )

    def step(acc: Column, piece: Column) -> Column:
        full = F.length(acc["cur"]) + F.length(piece) > limit
        closes = full & (acc["cur"] != "")
        return F.struct(
            F.when(closes, F.array_append(acc["done"], acc["cur"]))
            .otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), piece)
            .otherwise(F.concat(acc["cur"], F.lit(glue), piece)).alias("cur"),
        )

    def finish(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(
            acc["done"]
        )

    return F.aggregate(F.split(c, separator), start, step, finish)


def chunk_sentences(c: Column, limit: int = 500) -> Column:
    flat = F.regexp_replace(c, "\n", " ")
    return F.transform(pack_pieces(flat, r"\. ", limit, ". "), strip)


def chunk_lines(c: Column, limit: int = 4500) -> Column:
    """Texts over ``limit`` characters, packed line by line; shorter ones stay whole."""
    return F.when(F.length(c) > limit, pack_pieces(c, "\n", limit, "\n")).otherwise(F.array(c))


def preview(c: Column, width: int = 100) -> Column:
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width)), F.lit("..."))).otherwise(c)


def code_mix(text_en: Column, translated: Column, keep: list[str]) -> Column:
    """Blend a translation with the English anchor words of the original."""
    anchors = F.array(*[F.lit(w) for w in keep])

    def blend(w: Column) -> Column:
        kept = F.filter(
            w, lambda x: F.array_contains(anchors, F.lower(F.regexp_replace(x, "[^a-zA-Z]", "")))
        )

        def choose(k: Column) -> Column:
            base = or_else(translated, text_en)
            return (
                F.when(F.size(k) == 0, base)
                .when(F.size(k) == F.size(w), text_en)
                .when(
                    F.size(k) <= 2,
                    F.concat(base, F.lit(" ("), F.array_join(k, " "), F.lit(")")),
                )
                .otherwise(base)
            )

        return let(kept, choose)

    return let(words(text_en), blend)
