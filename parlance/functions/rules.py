"""Ordered rewrite rules for styles and dialects, and the folds that apply them.

Rule order is meaning: an early short rule keeps a later longer one from firing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.text import let

# Languages, their codes and role labels.
LANGUAGES = {
    "hindi": {"code": "hi", "Doctor": "डॉक्टर", "Patient": "मरीज़"},
    "marathi": {"code": "mr", "Doctor": "डॉक्टर", "Patient": "रुग्ण"},
}
STYLES = ["formal_translated", "colloquial", "code_mixed"]
DIALECTS = ["standard_pune", "mumbai", "vidarbha", "marathwada", "konkan"]

# English words kept as they are in code-mixed speech.
CODE_MIX_KEEP = [
    "depression", "anxiety", "ptsd", "stress", "mood", "sleep", "memory",
    "focus", "panic", "trauma", "therapy", "doctor", "medication", "hospital",
    "ok", "okay", "yes", "no", "hi", "bye", "hello", "thanks", "sorry",
    "feeling", "feel", "mind", "brain", "energy", "tired", "sad",
]

# Clinical word patterns and their plain-English wording.
PLAIN_ENGLISH = [
    (r"\bdepression\b", "sadness and hopelessness"),
    (r"\banxiety\b", "worry and fear"),
    (r"\bptsd\b", "trauma from a past event"),
    (r"\bsuicidal\b", "not wanting to live"),
    (r"\bself.harm\b", "hurting myself"),
    (r"\binsomnia\b", "not being able to sleep"),
    (r"\banhedonia\b", "not enjoying anything"),
    (r"\bfatigue\b", "extreme tiredness"),
    (r"\birritab\w+\b", "getting angry easily"),
    (r"\bconcentrat\w+\b", "unable to focus"),
    (r"\bhopeless\w*\b", "feeling that nothing will get better"),
    (r"\bworthless\w*\b", "feeling useless"),
    (r"\bdiagnos\w+\b", "identified as having"),
    (r"\btherapy\b", "treatment and counseling"),
    (r"\bmedication\b", "medicine"),
    (r"\bsymptom\w*\b", "problem"),
    (r"\bpsychiatri\w+\b", "mental health doctor"),
    (r"\bpsychologi\w+\b", "mental health counselor"),
]

# Formal → regional wording, in order, one list per dialect.
DIALECT_RULES = {
    "standard_pune": [],
    "mumbai": [
        ("करत आहे", "करतोय"), ("करत आहेस", "करतोयस"), ("करत आहेत", "करतायत"),
        ("येत आहे", "येतोय"), ("जात आहे", "जातोय"), ("वाटत आहे", "वाटतंय"),
        ("होत आहे", "होतंय"), ("बसत आहे", "बसतोय"), ("राहत आहे", "राहतोय"),
        ("झाले", "झालं"), ("केले", "केलं"), ("गेले", "गेलं"), ("आले", "आलं"),
        ("बोलले", "बोललं"), ("सांगितले", "सांगितलं"),
        ("नाही", "नाय"), ("आहे का", "हाय का"), ("चांगले", "भारी"),
        ("खूप चांगले", "एकदम भारी"), ("ठीक आहे", "ठीके"), ("तुम्हाला", "तुला"),
        ("तुमचे", "तुझं"), ("माझे", "माझं"), ("त्याचे", "त्याचं"),
        ("समजले", "समजलं"), ("होय", "हां"), ("कारण", "क्युंकी"),
    ],
    "vidarbha": [
        ("नाही", "नाय"), ("आहे", "हाय"), ("होते", "होतं"), ("करत आहे", "करतोय"),
        ("वाटत नाही", "वाटंना"), ("येत नाही", "येईना"), ("जात नाही", "जाईना"),
        ("होत नाही", "होईना"), ("कळत नाही", "कळंना"), ("समजत नाही", "समजंना"),
        ("दिसत नाही", "दिसंना"), ("ऐकत नाही", "ऐकंना"),
        ("काय", "काऊन"), ("कसे", "कसं"), ("असे", "असं"), ("तसे", "तसं"),
        ("चांगले", "बरं"), ("झाले", "झालं"), ("केले", "केलं"), ("गेले", "गेलं"),
        ("तुम्ही", "तुमी"), ("आम्ही", "आमी"), ("तुम्हाला", "तुम्हाले"),
    ],
    "marathwada": [
        ("नाही", "नाय"), ("आहे", "हाय"), ("होते", "व्हतं"), ("करत आहे", "करतुया"),
        ("येत आहे", "येतुया"), ("जात आहे", "जातुया"), ("वाटत आहे", "वाटतंय"),
        ("झाले", "झालं"), ("केले", "केलं"), ("गेले", "गेलं"), ("आले", "आलं"),
        ("काय", "काय"), ("कसे आहात", "कसं हाय"), ("कसे आहे", "कसं हाय"),
        ("चांगले", "बरं"), ("खूप", "फार"), ("आता", "आता"), ("मग", "मंग"),
        ("तुम्ही", "तुमी"), ("तुम्हाला", "तुमास्नी"), ("आम्हाला", "आमास्नी"),
    ],
    "konkan": [
        ("नाही", "ना"), ("आहे", "आसा"), ("होते", "होतां"), ("करत आहे", "करता"),
        ("वाटत नाही", "दिसना"), ("येत नाही", "येना"), ("समजत नाही", "कळना"),
        ("झाले", "जालां"), ("केले", "केलां"), ("गेले", "गेलां"), ("आले", "आयलां"),
        ("बोलले", "बोल्लां"),
        ("काय", "कितें"), ("कसे", "कशें"), ("होय", "व्हय"), ("चांगले", "बरें"),
        ("आता", "आतां"),
        ("मी", "हांव"), ("तू", "तूं"), ("तुम्ही", "तुमी"), ("आम्ही", "आमी"),
        ("माझे", "माजें"), ("तुमचे", "तुमचें"),
    ],
}

# Fillers and their chance per dialect, and the general fillers.
DIALECT_FILLERS = {
    "mumbai": (0.12, ["यार", "बॉस", "भाई", "अरे", "चल", "एक्चुअली", "बेसिकली"]),
    "vidarbha": (0.10, ["बग", "व्हय", "काऊन", "अरे बाबा"]),
    "marathwada": (0.10, ["व्हय", "बर का", "मंग", "अस्सं"]),
    "konkan": (0.10, ["रे", "गा", "बाबा", "अगो"]),
}
PATIENT_FILLERS = [
    "बघा", "बघ", "अरे", "हां", "ना", "म्हणजे", "खरं तर",
    "असं वाटतं", "काय सांगू", "माहित नाही पण",
]
DOCTOR_FILLERS = ["बरं", "हो", "ठीक", "समजलं", "अच्छा"]
DIALECT_FILLER_MIN_CHARS = 15
SPOKEN_FILLER_MIN_CHARS = 20

# Formal → spoken wording, in order.
SPOKEN_RULES = [
    ("करत आहे", "करतोय"), ("करत आहेत", "करतायत"), ("करत आहेस", "करतोयस"),
    ("करत नाही", "करत नाय"), ("येत आहे", "येतोय"), ("जात आहे", "जातोय"),
    ("बसत आहे", "बसतोय"), ("बोलत आहे", "बोलतोय"), ("ऐकत आहे", "ऐकतोय"),
    ("पाहत आहे", "पाहतोय"), ("वाटत आहे", "वाटतंय"), ("होत आहे", "होतंय"),
    ("राहत आहे", "राहतोय"), ("खात आहे", "खातोय"), ("पीत आहे", "पितोय"),
    ("झोपत आहे", "झोपतोय"),
    ("झाले आहे", "झालंय"), ("झाले", "झालं"), ("केले", "केलं"), ("गेले", "गेलं"),
    ("आले", "आलं"), ("बोलले", "बोललं"), ("सांगितले", "सांगितलं"), ("दिले", "दिलं"),
    ("घेतले", "घेतलं"), ("पाहिले", "पाहिलं"), ("ऐकले", "ऐकलं"), ("खाल्ले", "खाल्लं"),
    ("बसले", "बसलं"), ("उठले", "उठलं"),
    ("काय आहे", "काय आहे"), ("नाही आहे", "नाहीये"), ("आहे का", "आहे का"),
    ("होते", "होतं"), ("असते", "असतं"), ("म्हणजे", "म्हंजे"), ("कारण", "कारण"),
    ("परंतु", "पण"), ("आणि", "आणि"), ("तुम्हाला", "तुम्हाला"), ("तुमचे", "तुझं"),
    ("तुमची", "तुझी"), ("तुमच्या", "तुझ्या"), ("माझे", "माझं"), ("माझी", "माझी"),
    ("त्याचे", "त्याचं"), ("त्याची", "त्याची"), ("तिचे", "तिचं"), ("आमचे", "आमचं"),
    ("का?", "का?"), ("कसे आहात", "कसं आहेस"), ("कसे आहे", "कसं आहे"),
    ("आपण", "तू"), ("आपल्याला", "तुला"),
    ("चांगले आहे", "बरं आहे"), ("खूप चांगले", "एकदम भारी"), ("ठीक आहे", "ठीके"),
    ("बरोबर आहे", "बरोबर"), ("समजले", "समजलं"), ("कळले", "कळलं"),
]

# Clinical wording → patients' own expressions, in order.
SLANG_RULES = [
    ("उदास वाटत", "मन लागत नाही"), ("उदासीनता", "मन उदास"),
    ("निराश वाटत", "काहीच बरं वाटत नाही"), ("निराशा", "मन खिन्न"),
    ("दुःखी", "वाईट वाटतं"), ("आनंद नाही", "मजा नाही"),
    ("आनंद वाटत नाही", "काहीच मजा नाही"),
    ("चिंता वाटते", "टेन्शन येतं"), ("चिंताग्रस्त", "टेन्शन मध्ये"),
    ("काळजी वाटते", "काळजी वाटतेय"), ("भीती वाटते", "भीती वाटतेय"),
    ("घाबरलेले", "घाबरलोय"),
    ("झोप येत नाही", "झोप लागत नाही"), ("निद्रानाश", "झोप उडालीय"),
    ("झोपेची समस्या", "झोपेचं टेन्शन"), ("रात्री जागे", "रात्री जागं राहतो"),
    ("थकवा", "दमायला होतं"), ("थकलेले", "दमलोय"), ("ऊर्जा नाही", "एनर्जी नाही"),
    ("डोकेदुखी", "डोकं दुखतंय"), ("छातीत दुखते", "छातीत धडधड होते"),
    ("भूक नाही", "खाण्याची इच्छा नाही"), ("भूक कमी", "भूक लागत नाही"),
    ("जास्त खातो", "खूप खातो"),
    ("लक्ष केंद्रित करू शकत नाही", "लक्ष लागत नाही"),
    ("एकाग्रता नाही", "डोकं चालत नाही"),
    ("बरे वाटत नाही", "बरं वाटत नाहीये"), ("त्रास होतो", "त्रास होतोय"),
    ("समस्या आहे", "प्रॉब्लेम आहे"),
]

# Verb endings by speaker gender, in order.
MALE_RULES = [
    ("मी गेले", "मी गेलो"), ("मी आले", "मी आलो"), ("मी केले", "मी केलं"),
    ("मी बोलले", "मी बोललो"), ("मी पाहिले", "मी पाहिलं"), ("मी ऐकले", "मी ऐकलं"),
    ("मला वाटले", "मला वाटलं"), ("मी थकले", "मी थकलो"), ("मी झोपले", "मी झोपलो"),
    ("मी उठले", "मी उठलो"), ("मी खाल्ले", "मी खाल्लं"), ("मी बसले", "मी बसलो"),
]
FEMALE_RULES = [
    ("मी गेलो", "मी गेले"), ("मी आलो", "मी आले"), ("मी बोललो", "मी बोलले"),
    ("मी थकलो", "मी थकले"), ("मी झोपलो", "मी झोपले"), ("मी उठलो", "मी उठले"),
    ("मी बसलो", "मी बसले"),
]

# English note terms and their Marathi wording, in order.
NOTE_TERMS = [
    ("sad", "दुःखी"), ("sadness", "दुःख"), ("depression", "नैराश्य"),
    ("anxiety", "चिंता"), ("feeling sad", "दुःखी वाटणे"), ("low energy", "कमी ऊर्जा"),
    ("difficulty sleeping", "झोपेत अडचण"), ("sleep problems", "झोपेच्या समस्या"),
    ("appetite", "भूक"), ("concentration", "एकाग्रता"), ("motivation", "प्रेरणा"),
    ("energy level", "ऊर्जा पातळी"),
    ("patient", "रुग्ण"), ("diagnosis", "निदान"), ("treatment", "उपचार"),
    ("therapy", "थेरपी"), ("counseling", "समुपदेशन"), ("medication", "औषध"),
    ("follow-up", "पुढील भेट"), ("assessment", "मूल्यमापन"), ("symptoms", "लक्षणे"),
    ("SUBJECTIVE", "व्यक्तिनिष्ठ माहिती"), ("OBJECTIVE", "वस्तुनिष्ठ निरीक्षण"),
    ("ASSESSMENT", "मूल्यमापन"), ("PLAN", "उपचार योजना"),
]


def apply_rules(text: Column, rules: list[tuple[str, str]], longest_first: bool = False) -> Column:
    """Literal replacements one after another; ``longest_first`` re-orders by length."""
    if longest_first:
        rules = sorted(rules, key=lambda r: -len(r[0]))
    for old, new in rules:
        if old != new:
            text = F.replace(text, F.lit(old), F.lit(new))
    return text


def to_dialect(text: Column, dialect: str, longest_first: bool = False) -> Column:
    return apply_rules(text, DIALECT_RULES[dialect], longest_first)


def to_spoken(text: Column) -> Column:
    return apply_rules(text, SPOKEN_RULES)


def to_slang(text: Column) -> Column:
    return apply_rules(text, SLANG_RULES)


def to_gender(text: Column, role: Column, gender: Column) -> Column:
    """Patient turns follow the speaker's gender: ``male``, else the female list."""
    return F.when(
        role == "Patient",
        F.when(gender == "male", apply_rules(text, MALE_RULES))
        .when(gender == "female", apply_rules(text, FEMALE_RULES))
        .otherwise(text),
    ).otherwise(text)


def to_plain_english(text: Column) -> Column:
    out = F.lower(text)
    for pattern, wording in PLAIN_ENGLISH:
        out = F.regexp_replace(out, f"(?iU){pattern}", wording)
    return out


def usable_terms(vocabulary: dict[str, dict[str, str]]) -> list[tuple[int, str, str]]:
    """(place, term, wording): the colloquial, else the formal form of each key."""
    worded = [
        (key, forms.get("colloquial") or forms.get("formal") or "") for key, forms in vocabulary.items()
    ]
    return [(i, k, w) for i, (k, w) in enumerate(worded) if w and not k.startswith("_")]


def word_terms(text: Column, terms: Column) -> Column:
    """Terms that stand in the untouched text as whole words give way to their wordings, in turn.

    ``terms`` is an array of structs with ``term`` and ``wording``. A term is looked for in
    the lower-cased text and replaced in any letter case, also in earlier wordings.
    """
    # A term and a wording are texts, not patterns. The borders are looked for where the term
    # stands: a pattern that begins with one asks for it at each character.
    def whole(t: Column) -> Column:
        term = F.concat(F.lit(r"\Q"), F.replace(t["term"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
        return F.concat(F.lit("(?U)"), term, F.lit(r"\b(?<=\b"), term, F.lit(")"))

    def plain(t: Column) -> Column:
        return F.replace(F.replace(t["wording"], F.lit("\\"), F.lit(r"\\")), F.lit("$"), F.lit(r"\$"))

    def run(x: Column) -> Column:
        present = F.filter(x["terms"], lambda t: F.contains(x["low"], t["term"]) & F.rlike(x["low"], whole(t)))
        return F.aggregate(
            present, x["text"],
            lambda out, t: F.regexp_replace(out, F.concat(F.lit("(?i)"), whole(t)), plain(t)),
        )

    return let(F.struct(text.alias("text"), F.lower(text).alias("low"), terms.alias("terms")), run)


def substitute_vocabulary(text: Column, vocabulary: dict[str, dict[str, str]]) -> Column:
    """Whole-word keys of the untouched text give way to their colloquial (else formal) form.

    For a vocabulary held in the program; ``glossary.substitute_terms`` takes one of any size.
    """
    terms = usable_terms(vocabulary)
    if not terms:
        return text
    return word_terms(text, F.array(*[
        F.struct(F.lit(t).alias("term"), F.lit(w).alias("wording")) for _, t, w in terms
    ]))


def translate_terms(text: Column, terms: list[tuple[str, str]] = NOTE_TERMS) -> Column:
    """Dictionary wording for terms as listed, capitalised and in upper case."""
    for english, local in terms:
        for form in dict.fromkeys([english, english.capitalize(), english.upper()]):
            text = F.replace(text, F.lit(form), F.lit(local))
    return text


def translate_terms_in_line(line: Column, terms: list[tuple[str, str]] = NOTE_TERMS) -> Column:
    """As ``translate_terms``, but only for terms found in the untouched line."""
    out, low = line, F.lower(line)
    for english, local in terms:
        present = F.contains(low, F.lit(english.lower()))
        for form in dict.fromkeys([english, english.capitalize(), english.upper()]):
            # Replacing the empty string changes nothing.
            out = F.replace(out, F.when(present, form).otherwise(""), F.lit(local))
    return out


def role_label(role: Column, language: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, spec in LANGUAGES.items():
        out = F.when(
            language == name,
            F.when(role == "Doctor", spec["Doctor"]).otherwise(spec["Patient"]),
        ).otherwise(out)
    return out


def draw(key: Column, seed: int, salt: str) -> Column:
    """Uniform number in [0, 1) that depends only on the row key and the seed."""
    digest = F.md5(F.concat_ws(":", key, F.lit(f"{salt}:{seed}")))
    return F.conv(F.left(digest, F.lit(7)), 16, 10).cast("long") / float(16**7)


def pick(items: list[str], key: Column, seed: int, salt: str) -> Column:
    at = F.floor(draw(key, seed, salt) * len(items)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in items]), at)


def add_dialect_filler(text: Column, role: Column, dialect: str, key: Column, seed: int = 42) -> Column:
    """Now and then put a regional filler before or after a patient turn."""
    if dialect not in DIALECT_FILLERS:
        return text
    chance, fillers = DIALECT_FILLERS[dialect]
    filler = pick(fillers, key, seed, f"{dialect}-word")
    return F.when(
        (role == "Patient")
        & (F.length(text) >= DIALECT_FILLER_MIN_CHARS)
        & (draw(key, seed, f"{dialect}-chance") <= chance),
        F.when(draw(key, seed, f"{dialect}-side") < 0.5, F.concat(filler, F.lit(", "), text))
        .otherwise(F.concat(text, F.lit(" "), filler)),
    ).otherwise(text)


def add_spoken_filler(
    text: Column, role: Column, key: Column, chance: float = 0.1, seed: int = 42
) -> Column:
    """Now and then open a turn, or its second clause, with a conversational filler."""
    filler = F.when(role == "Patient", pick(PATIENT_FILLERS, key, seed, "spoken-p")).otherwise(
        pick(DOCTOR_FILLERS, key, seed, "spoken-d")
    )
    cut = F.regexp_instr(text, F.lit("[,।.]"))
    return F.when(
        (F.length(text) >= SPOKEN_FILLER_MIN_CHARS) & (draw(key, seed, "spoken-chance") <= chance),
        F.when(draw(key, seed, "spoken-side") > 0.5, F.concat(filler, F.lit(", "), text))
        .when(
            cut > 0,
            F.concat(
                F.substring(text, F.lit(1), cut), F.lit(" "), filler, F.lit(", "),
                F.btrim(F.substring(text, cut + 1, F.length(text))),
            ),
        )
        .otherwise(text),
    ).otherwise(text)
