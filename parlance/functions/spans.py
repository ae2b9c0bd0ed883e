"""Marked stretches of a text: keyword hits, pattern matches, merged highlights.

All offsets are zero-based character positions with an exclusive end, found in one
forward pass over the pieces between hits, inside the row.
"""

from __future__ import annotations

import re
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.arrays import let, running

SPAN = "array<struct<rule:int,label:string,start:int,stop:int,confidence:double>>"

# Clinical keywords per label, in order.
KEYWORDS = {
    "SYMPTOM": [
        "depression", "anxiety", "stress", "insomnia", "fatigue",
        "sadness", "hopelessness", "irritability", "panic",
        "mood swings", "lack of interest", "poor concentration",
        "appetite loss", "sleep disturbance", "low energy", "lack of motivation",
        "नैराश्य", "चिंता", "ताण", "थकवा", "निद्रानाश", "भूक कमी",
    ],
    "SEVERITY": [
        "mild depression", "moderate anxiety", "severe stress",
        "minimal symptoms", "extreme distress",
        "significant impairment", "chronic condition", "acute episode",
        "सौम्य लक्षणे", "मध्यम नैराश्य", "तीव्र चिंता", "गंभीर स्थिती",
    ],
    "MEDICATION": [
        "antidepressant", "anxiolytic", "ssri", "snri",
        "therapy", "counseling", "medication", "psychotherapy",
    ],
}
INDIC_KEYWORDS = {
    **KEYWORDS,
    "SYMPTOM": KEYWORDS["SYMPTOM"] + [
        "उदासीनता", "भीती", "अस्वस्थता", "निद्रानाश",
        "दुःख", "निराशा", "चिडचिड", "घबराट",
        "तनाव", "चिंता", "थकान", "नींद", "भूख",
    ],
    "CONDITION": [
        "depression", "anxiety disorder", "ptsd", "bipolar",
        "नैराश्य विकार", "चिंता विकार",
    ],
}
KEYWORD_CONFIDENCE, PATTERN_CONFIDENCE = 0.9, 0.95

# Marathi patterns per label, in order.
PATTERNS = {
    "SYMPTOM": [
        r"(निद्रानाश|झोप\s+(?:येत\s+नाही|नीट\s+होत\s+नाही|कमी|व्यत्यय|समस्या))",
        r"(रात्री\s+झोप\s+(?:घेणे|लागणे))",
        r"(उशिरा\s+झोपतो|उशिरा\s+झोपणे)",
        r"(थकवा|थकलेलो|थकलेली|कमी\s+उर्जा|ऊर्जा\s+कमी)",
        r"(भूक\s+(?:कमी|नाही|लागत\s+नाही)|जेवण\s+(?:कमी|नाही))",
        r"(एकाग्रता\s+(?:कमी|समस्या|नाही)|लक्ष\s+(?:लागत\s+नाही|कमी|कमतरता))",
        r"(लक्ष\s+कमतरता\s+विकार)",
        r"(आत्महत्या(?:चे\s+विचार)?|स्वतःला\s+इजा|जगणे\s+नको)",
        r"(डोकेदुखी|छातीत\s+दुखणे|पोटदुखी|श्वास\s+(?:घेणे\s+कठीण|लागणे))",
        r"(भयग्रस्त\s+झटका|घाबरणे|धडधड)",
    ],
    "EMOTION": [
        r"(नैराश्य(?:ाचे|ाने)?)",
        r"(चिंता(?:ग्रस्त)?|काळजी(?:\s+वाटते)?)",
        r"(ताण(?:\s+आहे|\s+वाटतो)?)",
        r"(दुःख(?:ी)?|उदास|मन\s+(?:खिन्न|जड))",
        r"(राग(?:\s+येतो|\s+नियंत्रण)?|चिडचिड(?:ेपणा)?)",
        r"(भीती(?:\s+वाटते)?|घाबरतो|घाबरते)",
        r"(लाज(?:\s+वाटली|\s+वाटते)?|लाजाळू)",
        r"(अपराध(?:बोध|ी\s+वाटणे))",
        r"(निराशा|निरुत्साह)",
        r"(एकटेपणा|एकटे\s+(?:वाटते|असणे))",
        r"(आनंद(?:ी)?|उत्साह(?:ी)?|समाधान(?:ी)?)",
        r"(अस्वस्थ(?:ता)?|बेचैन)",
    ],
    "DURATION": [
        r"(\d+\s+(?:दिवसांपूर्वी|आठवड्यांपूर्वी|महिन्यांपूर्वी|वर्षांपूर्वी))",
        r"(\d+\s+(?:दिवस|आठवडे|महिने|वर्षे)\s+(?:झाले|पासून))",
        r"(महिन्यातून\s+(?:एकदा|दोनदा|तीनदा|\d+\s+वेळा?))",
        r"(आठवड्यातून\s+(?:एकदा|दोनदा|\d+\s+वेळा?))",
        r"(नेहमी|नेहमीच|सतत|सर्व\s+वेळ)",
        r"(कधीकधी|कधी\s+कधी|अधूनमधून)",
        r"(क्वचित(?:च)?|कधीच\s+नाही|बऱ्याच\s+वेळा)",
        r"(अलीकडे|अलीकडील|गेल्या\s+काही\s+(?:दिवसांत|महिन्यांत))",
    ],
    "SEVERITY": [
        r"(सौम्य\s+(?:लक्षणे|समस्या|स्थिती))",
        r"(मध्यम\s+(?:लक्षणे|समस्या|तीव्रता))",
        r"(तीव्र\s+(?:लक्षणे|समस्या|नैराश्य|चिंता))",
        r"(गंभीर\s+(?:परिस्थिती|स्थिती|समस्या))",
        r"(वाढत\s+(?:आहे|चालले)|आणखी\s+(?:वाईट|त्रासदायक))",
        r"(सुधारत\s+(?:आहे|आहोत)|बरे\s+होत\s+(?:आहे|आहोत))",
    ],
    "TREATMENT": [
        r"(मनोचिकित्स(?:क|ा|ेकडे))",
        r"(समुपदेशन|समुपदेशक)",
        r"(थेरपी|थेरपिस्ट)",
        r"(औषध(?:े|ोपचार|े\s+घेतो|े\s+घेते)?)",
        r"(डॉक्टर(?:ांकडे|ांना)?)",
        r"(उपचार(?:\s+घेतो|\s+घेते|\s+सुरू)?)",
        r"(रुग्णालय|हॉस्पिटल)",
    ],
    "LIFESTYLE": [
        r"(व्यायाम(?:\s+करतो|\s+करते)?)",
        r"(झोपणे|झोपतो|झोपते|उशिरा\s+झोपणे)",
        r"(प्रवास(?:\s+करतो|\s+करते|\s+करायला)?)",
        r"(गोल्फ|पोहणे|पोहतो)",
        r"(मित्र(?:ांसोबत)?|मैत्रिणींसोबत)",
        r"(कॉफी|बिअर|मद्यपान|धूम्रपान)",
        r"(मैफिल|संगीत\s+(?:ऐकणे|वाजवणे))",
    ],
}

# Words worth highlighting in a note.
HIGHLIGHTS = [
    r"\bPHQ-?8\b", r"\bdiagnosis\b", r"\brisk\b", r"\bsafety\b", r"\bsuicide\b",
    r"\bself-harm\b", r"\bmedication\b", r"\bfollow-?up\b", r"\bmood\b", r"\bsleep\b",
    r"\bappetite\b", "जोखीम", "आत्महत्या", "उपचार", "औषध", "अनुवर्ती", "थकवा",
    "मानसिक स्थिती",
]

# Symptom and emotion words with the context width around a first hit.
SYMPTOM_WORDS = [
    "sad", "sadness", "depressed", "depression", "anxious", "anxiety",
    "tired", "fatigue", "energy", "sleep", "sleeping", "insomnia",
    "appetite", "eating", "weight", "concentration", "focus",
    "worry", "nervous", "irritable", "angry", "hopeless", "worthless",
    "suicidal", "self-harm", "crying", "mood", "interest", "pleasure",
]
EMOTION_WORDS = [
    "happy", "sad", "angry", "frustrated", "hopeless", "helpless",
    "guilty", "ashamed", "worried", "scared", "nervous", "calm",
    "stressed", "overwhelmed", "isolated", "lonely",
]
CONTEXT_CHARS = 30
SYMPTOM_SCORE, EMOTION_SCORE = 0.95, 0.90


def quoted(text: str) -> str:
    return re.escape(text)


def flat_rules(groups: dict[str, list[str]]) -> list[tuple[int, str, str]]:
    """(running number, label, rule) in list order."""
    pairs = [(label, rule) for label, rules in groups.items() for rule in rules]
    return [(i, label, rule) for i, (label, rule) in enumerate(pairs)]


def _running_ends(lengths: Column) -> Column:
    """Cumulative sums of an array of ints."""
    return running(lengths, lambda a, b: a + b)


def keyword_spans(text: Column, groups: dict[str, list[str]]) -> Column:
    """Every occurrence of every keyword, overlapping ones included.

    The text is cut before each place where some keyword starts; each cut is then
    compared with the keyword list.
    """
    rules = flat_rules(groups)
    distinct = sorted({kw.lower() for _, _, kw in rules}, key=len, reverse=True)
    longest = max(len(kw) for kw in distinct)
    cut = "(?=" + "|".join(quoted(kw) for kw in distinct) + ")"
    table = F.array(
        *[
            F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"),
                     F.lit(kw.lower()).alias("kw"), F.lit(len(kw)).alias("len"))
            for i, label, kw in rules
        ]
    )

    def hits_in(b: Column) -> Column:
        pieces, ends = b["pieces"], b["ends"]

        def at_piece(piece: Column, n: Column) -> Column:
            # What follows the cut, from the next pieces: the text is not walked again.
            ahead = F.left(F.array_join(F.slice(pieces, n + 1, F.lit(longest)), ""), F.lit(longest))
            at = F.get(ends, n) - F.length(piece)
            return let(
                F.struct(ahead.alias("ahead"), at.alias("at")),
                lambda x: F.transform(
                    F.filter(table, lambda k: F.startswith(x["ahead"], k["kw"])),
                    lambda k: F.struct(
                        k["rule"].alias("rule"), k["label"].alias("label"),
                        x["at"].alias("start"), (x["at"] + k["len"]).alias("stop"),
                        F.lit(KEYWORD_CONFIDENCE).alias("confidence"),
                    ),
                ),
            )

        return F.flatten(F.transform(pieces, at_piece))

    def cut_up(pieces: Column) -> Column:
        ends = _running_ends(F.transform(pieces, F.length))
        return let(F.struct(pieces.alias("pieces"), ends.alias("ends")), hits_in)

    low = F.lower(text)
    found = let(F.split(low, cut), cut_up)
    return F.when(low.rlike(cut), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


# Characters of a block of text that a span is read from.
TEXT_BLOCK = 1024


def with_entities(text: Column, spans: Column) -> Column:
    """The spans with the text they mark as ``entity``.

    A place in a text is found by walking there from its start, so the text is cut into
    blocks once and a span reads the one or two it lies in.
    """
    last = F.floor((F.greatest(F.length(text), F.lit(1)) - 1) / TEXT_BLOCK).cast("int")
    blocks = F.transform(
        F.sequence(F.lit(0), last), lambda k: F.substring(text, k * TEXT_BLOCK + 1, F.lit(TEXT_BLOCK))
    )

    def read(b: Column, s: Column) -> Column:
        n = s["stop"] - s["start"]
        first = F.floor(s["start"] / TEXT_BLOCK).cast("int")
        near = F.array_join(F.slice(b, first + 1, F.floor(n / TEXT_BLOCK).cast("int") + 2), "")
        return F.substring(near, s["start"] % TEXT_BLOCK + 1, n)

    return F.when(
        F.size(spans) > 0,
        let(
            F.struct(blocks.alias("b"), spans.alias("s")),
            lambda x: F.transform(x["s"], lambda s: s.withField("entity", read(x["b"], s))),
        ),
    )


def openings(pattern: str) -> set[str] | None:
    """Texts one of which every match of a pattern starts with, in lower case; None if unknown."""

    def starts(items) -> set[tuple[str, bool]]:
        """Beginnings of a sequence, and whether what follows it may go on from them."""
        found = {("", True)}
        for item in items:
            follow = one(*item)
            found = {
                (text + more, goes_on) if on else (text, False)
                for text, on in found for more, goes_on in (follow if on else [("", False)])
            }
        return found

    def one(kind, value) -> set[tuple[str, bool]]:
        if kind is parser.LITERAL:
            return {(chr(value).lower(), True)}
        if kind is parser.IN and value == [(parser.CATEGORY, parser.CATEGORY_DIGIT)]:
            return {(d, True) for d in "0123456789"}
        if kind is parser.IN and all(k is parser.LITERAL for k, _ in value):
            return {(chr(v).lower(), True) for _, v in value}
        if kind is parser.AT:
            return {("", True)}
        if kind is parser.SUBPATTERN:
            return starts(value[-1])
        if kind is parser.BRANCH:
            return set().union(*[starts(b) for b in value[1]])
        if kind is parser.MAX_REPEAT:
            least, most, what = value
            once = {(text, on and most == 1) for text, on in starts(what)}
            return once | ({("", True)} if least == 0 else set())
        return {("", False)}

    texts = {text for text, _ in starts(parser.parse(pattern))}
    return None if "" in texts else texts


def prefix_tree(words: set[str]) -> str:
    """A pattern for any of the words, common beginnings factored out."""
    heads: dict[str, set[str]] = {}
    for w in words:
        heads.setdefault(w[:1], set()).add(w[1:])
    if "" in heads:
        return ""
    branches = [quoted(c) + prefix_tree(rest) for c, rest in sorted(heads.items())]
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def match_spans(text: Column, rules: list[tuple[int, str, str]], confidence: float) -> Column:
    """Left-to-right, non-overlapping matches of each pattern, letter case ignored.

    A prefix tree of all patterns' openings tells in one pass whether any of them can match;
    a text without one, as those in another script, is not looked at again. A pattern that
    matches leaves the pieces between its hits and the hits themselves; their lengths, summed
    in turn, are the offsets.
    """
    known = [openings(pattern) for _, _, pattern in rules]
    every = set().union(*[o for o in known if o])
    # Of two openings the shorter is kept where the longer starts with it.
    shortest = {w for w in every if not any(w[:n] in every for n in range(1, len(w)))}
    cut = []
    for number, label, rule in rules:
        pattern = f"(?i){rule}"
        cut.append(F.when(
            text.rlike(pattern),
            F.struct(
                F.lit(number).alias("rule"), F.lit(label).alias("label"),
                F.split(text, pattern, -1).alias("gaps"),
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
            ),
        ))

    def place(m: Column) -> Column:
        lengths = F.flatten(
            F.zip_with(m["gaps"], m["hits"], lambda g, h: F.array(
                F.length(g), F.coalesce(F.length(h), F.lit(0))
            ))
        )
        return let(
            _running_ends(lengths),
            lambda ends: F.transform(
                m["hits"],
                lambda _, k: F.struct(
                    m["rule"].alias("rule"), m["label"].alias("label"),
                    F.get(ends, 2 * k).alias("start"), F.get(ends, 2 * k + 1).alias("stop"),
                    F.lit(confidence).alias("confidence"),
                ),
            ),
        )

    found = F.flatten(F.transform(F.array_compact(F.array(*cut)), place)).cast(SPAN)
    none = F.array().cast(SPAN)
    if None in known or not shortest:
        return F.coalesce(found, none)
    return F.when(text.rlike(f"(?i){prefix_tree(shortest)}"), found).otherwise(none)


def pattern_spans(text: Column, groups: dict[str, list[str]] = PATTERNS) -> Column:
    return match_spans(text, flat_rules(groups), PATTERN_CONFIDENCE)


def merge_spans(spans: Column) -> Column:
    """Sorted array<struct<start,stop>> with overlapping or touching spans united."""
    plain = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop")))
    )

    def unite(b: Column) -> Column:
        s, far = b["s"], b["far"]
        # A span that starts behind all stops before it begins a new one.
        heads = F.filter(
            F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] > F.get(far, i - 1)), i)),
            lambda i: i.isNotNull(),
        )
        return let(
            heads,
            lambda h: F.transform(
                h,
                lambda i, k: F.struct(
                    F.get(s, i)["start"].alias("start"),
                    F.get(far, F.coalesce(F.get(h, k + 1), F.size(s)) - 1).alias("stop"),
                ),
            ),
        )

    def bind(s: Column) -> Column:
        far = running(F.transform(s, lambda x: x["stop"]), lambda a, x: F.greatest(a, x))
        return let(F.struct(s.alias("s"), far.alias("far")), unite)

    return let(plain, bind)


def highlight_spans(text: Column, patterns: list[str] = HIGHLIGHTS) -> Column:
    rules = [(i, "HIGHLIGHT", p) for i, p in enumerate(patterns)]
    return merge_spans(match_spans(text, rules, 1.0))
