import pytest
from pyspark.sql import functions as F

from parlance.functions import rules, scores, sections, spans, text
from parlance.functions.sections import EMPTY_SECTION
from parlance.operators import glossary as G

T = F.col("t")


@pytest.mark.parametrize(
    "value, expected",
    [
        ("", "english"), ("plain words", "english"), ("मला ताण आहे", "hindi"), ("मळमळ होते", "marathi"),
        ("12 34 56", "mixed"), ("कखग" + "1234567", "mixed"), ("कखगघ" + "123456", "hindi"), ("[]^_`\\", "english"),
    ],
)
def test_detect_language(one, value, expected):
    assert one(text.detect_language(T), t=value) == expected


@pytest.mark.parametrize(
    "dialect, value, expected",
    [
        ("mumbai", "मी काम करत आहेत", "मी काम करतोयत"),  # the short rule fires first
        ("mumbai", "खूप चांगले", "खूप भारी"),
        ("vidarbha", "वाटत नाही", "वाटत नाय"),
        ("konkan", "कमी", "कहांव"),  # no word boundaries
        ("standard_pune", "करत आहे", "करत आहे"),
    ],
)
def test_dialect_rule_order(one, dialect, value, expected):
    assert one(rules.to_dialect(T, dialect), t=value) == expected


def test_longest_first_revives_long_rules(one):
    assert one(rules.to_dialect(T, "vidarbha", longest_first=True), t="वाटत नाही") == "वाटंना"


def test_gender_rules_touch_patients_only(one):
    c = rules.to_gender(T, F.col("r"), F.col("g"))
    assert one(c, t="मी गेले", r="Patient", g="male") == "मी गेलो"
    assert one(c, t="मी गेलो", r="Patient", g="female") == "मी गेले"
    assert one(c, t="मी गेले", r="Doctor", g="male") == "मी गेले"


def test_vocabulary_looks_at_the_untouched_text(one):
    vocabulary = {"low": {"colloquial": "very sad"}, "sad": {"formal": "X"}, "_sad": {"formal": "Y"}}
    assert one(rules.substitute_vocabulary(T, vocabulary), t="I am LOW") == "I am very sad"
    assert one(rules.substitute_vocabulary(T, vocabulary), t="low, Sad") == "very X, X"


def test_wordings_are_texts(one):
    vocabulary = {"a.b": {"formal": "x$1\\"}, "i'm ok": {"colloquial": "fine"}, "PTSD": {"formal": "never"}, "\\E": {"formal": "e"}}
    c = rules.substitute_vocabulary(T, vocabulary)
    assert one(c, t="A.b axb I'm OK ptsd") == "x$1\\ axb fine ptsd"
    assert one(rules.substitute_vocabulary(T, {}), t="same") == "same"


def test_vocabulary_of_any_size(spark):
    """Ten thousand terms: each text as if all were tried in turn, longest first."""
    import random
    import re

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))
    terms = {" ".join(word() for _ in range(rng.randrange(1, 4))): f"<{i}>" for i in range(12000)}
    terms |= {"a-b": "<dash>", "it's": "is", "caf\u00e9": "bar", "_x": "no", "b": ""}
    texts = [" ".join(rng.choice([word(), word().upper(), "a-b", "it's", "Caf\u00e9,"]) for _ in range(rng.randrange(30))) for _ in range(40)]
    texts += [None, "", "caf\u00e9s caf\u00e9", "xa-b a-bx a-b"]
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else i % 7, t, "c") for i, t in enumerate(texts)], "k long, s long, text string, term string")
    glossary = spark.createDataFrame([(e, w, "", "x") for e, w in terms.items()], "english string, marathi string, hindi string, category string")
    got = G.substitute_terms(rows, G.vocabulary_of(glossary), ["k", "s"])
    assert got.columns == rows.columns
    order = [t for t in sorted(terms, key=lambda t: (-len(t), t)) if terms[t] and not t.startswith("_")]
    for r in got.collect():
        want = texts[r.k]
        for t in order:
            if want and re.search(rf"\b{re.escape(t)}\b", texts[r.k].lower()):
                want = re.sub(rf"\b{re.escape(t)}\b", terms[t], want, flags=re.I)
        assert r.text == want, r.k
    none = G.vocabulary_of(glossary.limit(0))
    assert sorted(r.text or "" for r in G.substitute_terms(rows, none, ["k", "s"]).collect()) == sorted(t or "" for t in texts)


def test_openings_and_prefix_trees():
    assert spans.openings(r"(ab(?:c|d)?x|\d+ y)") == {"abcx", "abdx", "abx", *"0123456789"}
    assert spans.openings(r"[xy]z") == {"xz", "yz"} and spans.openings(r"\bPHQ-?8\b") == {"phq8", "phq-8"}
    assert spans.openings("x*") is None and spans.openings(r"\w+a") is None
    assert spans.prefix_tree({"abc", "abd", "x"}) == "(?:ab(?:c|d)|x)"


def test_patterns_run_only_where_they_may_match(one):
    """Patterns whose openings overlap, lie in one another, or are unknown."""
    import re

    groups = {"A": [r"(abc(?:d)?)", r"(bc+)", r"(\d+ (?:mg|ml))"], "B": [r"(\w+z)", r"(abcdef|ab)"]}
    for value in ("xABCDabcdefz 12 mg", "12 mgabc 3 ml", "", "nothing", "bccc ab ABz"):
        want = sorted(
            (i, m.start(), m.end()) for i, _, p in spans.flat_rules(groups) for m in re.finditer(p, value, re.I | re.A)
        )
        got = one(spans.pattern_spans(T, groups), t=value)
        assert sorted((s["rule"], s["start"], s["stop"]) for s in got) == want, value
    assert one(spans.pattern_spans(T, groups), t=None) == []


def test_line_terms(one):
    assert one(rules.translate_terms_in_line(T), t="Anxiety and PLAN") == "चिंता and उपचार योजना"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("ummmmmmmmmmm", "ummm"), ("so so so so so so go", "so go"), ("so so so so so go", "so so so so so go"),
        ("go on go on go on go on now", "go on now"), ("a  b", "a b"), ("जब जब जब जब जब जब ठीक", "जब ठीक"), (None, ""),
    ],
)
def test_clean_asr_text(one, value, expected):
    assert one(text.clean_asr_text(F.col("t").cast("string")), t=value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("a b c a b c", "a b c"), ("a b c a b d", "a b c a b d"), ("x y", "x y"),
        ("one two three " * 5 + "end", "one two three"), ("a b c " * 4, "a b c a b c"), (". . . . . . . hello", "hello"),
    ],
)
def test_collapse_loops(one, value, expected):
    assert one(text.collapse_loops(T), t=value) == expected


@pytest.mark.parametrize(
    "value, expected",
    [("...", True), ("a a a a a a a", False), ("a a a a a a a b", True), ("a b c d e f g h", False), ("a b " * 10, True)],
)
def test_low_info(one, value, expected):
    assert one(text.is_low_info(T), t=value) is expected


@pytest.mark.parametrize(
    "first, second, expected",
    [("5.0", "", 5), ("", "7", 7), ("bad", "7", None), (None, "", None), ("-3.9", "", -3)],
)
def test_label_scores(one, first, second, expected):
    c = scores.score_of(F.col("a").cast("string"), F.col("b").cast("string"))
    assert one(c, a=first, b=second) == expected


def test_bands(one):
    got = [one(scores.band(F.col("s").cast("int")), s=s) for s in (None, 4, 5, 14, 15, 19, 20)]
    assert got == ["unknown", "minimal", "mild", "moderate", "moderately_severe", "moderately_severe", "severe"]


def test_unknown_roles_are_kept_as_patient(one):
    assert one(scores.side_of(T), t="Therapor") == "patient"
    assert one(scores.role_of(T), t=" Ellie ") == "Doctor"


def test_chunks_hold_every_sentence(one):
    said = ". ".join(f"sentence number {i} is here" for i in range(60))
    got = one(text.chunk_sentences(T, 100), t=said)
    assert ". ".join(got) == said and max(map(len, got)) <= 102


def test_code_mix(one):
    c = text.code_mix(F.col("e"), F.col("m"), rules.CODE_MIX_KEEP)
    assert one(c, e="I feel odd", m="मला") == "मला (feel)"
    assert one(c, e="Yes, okay!", m="हो") == "Yes, okay!"
    assert one(c, e="nothing", m="") == "nothing"
    assert one(c, e="sad tired mood today", m="मला") == "मला"


def test_sections_with_long_headers(one):
    note = "**SUBJECTIVE:**\nsad\n- sad\nsad\n**OBJECTIVE:**\ncalm\n**ASSESSMENT:** mild\n**PLAN:**\n### rest"
    got = one(sections.split_sections_robust(T), t=note)
    assert got == {"subjective": "- sad", "objective": "- calm", "assessment": "- mild", "plan": "- rest"}


def test_sections_with_short_headers(one):
    got = one(sections.split_sections_robust(T), t="S:\nsad\nO:\ncalm\nP:\nrest")
    assert got == {"subjective": "- sad", "objective": "- calm", "assessment": EMPTY_SECTION, "plan": "- rest"}


def test_sections_from_json_and_from_nothing(one):
    got = one(sections.split_sections_robust(T), t='ok {"subjective": "sad", "plan": ["x"]} end')
    assert got["subjective"] == "- sad" and got["objective"] == EMPTY_SECTION and got["plan"] == '- ["x"]'
    got = one(sections.split_sections_robust(T), t="only words")
    assert got["subjective"] == "- only words" and got["plan"] == EMPTY_SECTION
    assert one(sections.split_sections_robust(T), t="")["plan"] == ""


def test_simple_sections_in_two_languages(one):
    got = one(sections.split_sections_simple(T), t="विषय\nएक\nObjective\ntwo\nयोजना\nthree\nPlan\nfour")
    assert got == {"subjective": "एक", "objective": "two", "assessment": "", "plan": "three\nfour"}


def test_prepare_conversation(one):
    said = "Doctor: hi\nDoctor:  HI!\nPatient: a\n...\n\nPatient: well,  ok"
    assert one(sections.prepare_conversation(T), t=said) == "Doctor: hi\n...\nPatient: well, ok"
    long = one(sections.prepare_conversation(T, 20), t="\n".join(f"line {i}" for i in range(20)))
    assert long.startswith("line 0") and long.endswith("line 19") and "trimmed" in long


def test_subsections(one):
    got = one(F.to_json(sections.subsections(T)), t="intro\nMood State:\n- low\nSleep Habits: - poor - short")
    assert got == ('[{"title":"Key Clinical Points","points":["intro"]},{"title":"Mood State","points":["low"]},'
                   '{"title":"Sleep Habits","points":["poor","short"]}]')


def test_keywords_overlap(one):
    got = one(F.to_json(spans.keyword_spans(T, {"S": ["stress", "distress", "ss"]})), t="Distresstress")
    hits = sorted((h["start"], h["stop"]) for h in __import__("json").loads(got))
    assert hits == [(0, 8), (2, 8), (6, 8), (7, 13), (11, 13)] or hits == [(0, 8), (2, 8), (6, 8), (11, 13)]


@pytest.mark.parametrize("value", ["stresstress", "sadness sadness", "चिंता चिंता", "no hit", "xsssx"])
def test_keywords_against_find(one, value):
    words = ["stress", "sadness", "चिंता", "ss", "sad"]
    want = sorted(
        (i, w) for w in words for i in range(len(value)) if value.startswith(w, i)
    )
    got = one(F.to_json(spans.keyword_spans(T, {"S": words})), t=value)
    have = sorted((h["start"], value[h["start"]:h["stop"]]) for h in __import__("json").loads(got))
    assert have == want


def test_highlights_merge(one):
    got = one(F.to_json(spans.highlight_spans(T)), t="औषधउपचार and Sleep")
    assert got == '[{"start":0,"stop":8},{"start":13,"stop":18}]'


def test_fenced_replies(one):
    assert one(sections.strip_fence(T), t='x ```json\n{"a":1}\n``` y') == '{"a":1}'
    assert one(sections.strip_fence(T), t=' {"a":1} ') == '{"a":1}'


def test_fillers_depend_on_key_only(one):
    c = rules.add_dialect_filler(T, F.lit("Patient"), "mumbai", F.col("k"))
    said = "मी घरी जातो आणि जेवतो"
    got = {one(c, t=said, k=str(k)) for k in range(40)}
    assert said in got and len(got) > 1
    assert one(rules.add_dialect_filler(T, F.lit("Doctor"), "mumbai", F.col("k")), t=said, k="1") == said
    assert all(said in g for g in got)


def test_squeezed_blanks_of_unicode(spark, one):
    """Runs of any blanks, ends included, as the spelt-out class has them; the class itself is not run."""
    blanks = text.BLANKS
    kinds = ["a" + b + "b" for b in blanks] + [b + "a" + b + " b" + b for b in blanks]
    kinds += ["a  b", " a b ", "a \u3000b\u3000 c", "", " ", blanks, "a\u200bb", "a\ufeff b", None]
    for value in kinds:
        want = None if value is None else " ".join("".join(" " if c in blanks else c for c in value).split(" ")).strip(" ")
        while want and "  " in want:
            want = want.replace("  ", " ")
        assert one(text.squeeze(T), t=value) == want, value
    said = f"A{blanks[0]}:{blanks[-1]}hi there\nB:x\nB : x\n : long\nC:\xa0\x1fok"
    assert one(sections.prepare_conversation(T), t=said) == "A: hi there\n: long\nC: ok"
    plan = spark.createDataFrame([("a",)], "t string").select(sections.prepare_conversation(T))
    assert text.WS not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_low_info_runs_are_not_stepped_through(spark, one):
    other = " ".join(f"w{i}" for i in range(20))
    cases = {
        f"{other} uh uh uh uh uh uh uh": True, f"uh uh uh uh uh uh uh {other}": True, f"a {'uh, ' * 7} {other}": True,
        f"{other} uh uh uh uh uh uh": False, f"{other} uh uh uh uh uh uh uhm": False, f"xuh {'uh ' * 6} {other}": False,
        f"{other} UH uh Uh uh uh uh uH b": True, f"{'ab ' * 6} abab {other}": False, "uh " * 7: False, "uh " * 8: True,
    }
    for value, want in cases.items():
        assert one(text.is_low_info(T), t=value) is want, value
    plan = spark.createDataFrame([("a",)], "t string").select(text.is_low_info(T))
    assert "aggregate(" not in plan._jdf.queryExecution().optimizedPlan().toString()


def test_word_terms_look_for_the_term_before_its_borders(spark):
    """Borders, cases, terms with marks, earlier wordings; no pattern that begins with a border."""
    terms = F.expr("array(struct('a.b' AS term, 'x$1' AS wording), struct('caf\u00e9' AS term, 'tea\\\\' AS wording), struct('x' AS term, 'y' AS wording), struct('-c' AS term, 'd' AS wording), struct('\U0001F600a' AS term, 'z' AS wording))")
    cases = {
        "A.B a.bc za.b a.b": "x$1 a.bc za.b x$1", "Caf\u00e9 caf\u00e9s CAF\u00c9": "tea\\ caf\u00e9s tea\\", "X xx _x x": "y xx _x y",
        "b-c -c b-C -cd": "bd -c bd -cd", "k\U0001F600a \U0001F600a": "kz \U0001F600a", "": "", "axb a-b": "axb a-b",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", rules.word_terms(T, terms).alias("o"))
    assert {r.t: r.o for r in df.collect()} == cases
    assert r"(?U)\b" not in df._jdf.queryExecution().analyzed().toString()
