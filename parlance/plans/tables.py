"""The given tables seen as conversations, notes, clips, chunks, patients and visits.

The given texts hold no clinical or Marathi words. ``en``, ``mr`` and ``note_text`` are
therefore derived from every word of every turn: each word picks a phrase from a fixed
list by its length and place. The SQL twins of these adaptors sit next to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import scores
from parlance.functions import text as text_functions
from parlance.operators import turns as T
from parlance.session import spread

CLINICIANS = ["assistant", "system"]
GENDERS = {0: "female", 1: "male"}

ENGLISH = [
    "how are you?", "i feel sad", "since when do you", "my sleep is poor,", "no energy.",
    "yes", "severe stress and", "follow up next visit.", "stresstress", "depression and anxiety",
    "tell me", "insomnia", "mood swings", "i'm tired", "the doctor said", "therapy",
    "suicidal thoughts", "self-harm", "irritable", "concentrating", "hopelessness", "worthless",
    "diagnosed with ptsd", "medication", "symptoms", "psychiatrist", "psychologist", "anhedonia",
    "fatigue", "panic", "okay", "lonely and scared", "mild depression", "SSRI", "low energy",
    "appetite loss", "any tablet", "dose", "diagnosis", "PHQ-8", "risk", "safety", "Appetite",
    "feeling sad", "difficulty sleeping", "happy", "Motivation.",
]
MARATHI = [
    "मी ठीक आहे", "करत आहे", "करत आहेत", "वाटत नाही", "झोप येत नाही,", "झाले", "मी गेले",
    "मी थकलो", "खूप चांगले", "कमी", "नैराश्य", "चिंता वाटते", "तुम्हाला", "काय", "कसे आहात",
    "थकवा", "भूक कमी", "3 महिने झाले", "औषधे घेतो", "उदास वाटत", "समस्या आहे", "कारण",
    "मला वाटले", "डॉक्टरांकडे", "रुग्ण", "तीव्र चिंता", "गंभीर स्थिती", "नाही", "होते",
    "आम्हाला", "काळजी वाटते", "निद्रानाश", "एकाग्रता नाही", "मी बसले", "सांगितले", "माझे",
    "तुमचे", "होय", "का?", "म्हणजे", "मळमळ।", "आत्महत्याचे विचार", "झोपतो", "मित्रांसोबत",
    "बरे वाटत नाही", "मी आलो", "घाबरते.",
]
NOTE_LINES = [
    "**SUBJECTIVE:**", "- poor sleep", "Chief Complaint:", "feels low most days", "low mood • tired",
    "OBJECTIVE:", "- calm", "- poor sleep", "### Plan", "weekly therapy", "**Assessment:**",
    "moderate depression", "S:", "O:", "- follow-up in two weeks", "Risk Formulation:", "no risk",
    "plan", "```", "P:", "विषय", "झोप कमी", "A:", "- - restless", "medication review",
    "Mental Status Exam: - quiet", "   ", "मूल्यांकन", "## Notes", "- Calm", "sleep diary",
    "calm\u2028- restless", "sleep\u00a0\u3000poor", "O:\r- quiet", "mood\x0blow\x85flat", "\u2003Risk\x1cnone\u2029",
]
VOCABULARY = {
    "sleep": {"colloquial": "झोप", "formal": "निद्रा"},
    "stress": {"formal": "ताण"},
    "doctor": {"colloquial": "डाक्टर"},
    "i'm tired": {"colloquial": "दमलोय"},
    "_note": {"colloquial": "x"},
    "mood": {"colloquial": "", "formal": "मनःस्थिती"},
}


# Tables whose rows carry long texts or arrays.
HEAVY = {"conversations", "documents", "embeddings"}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(table) if name in HEAVY else table


def lit_array(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def derive(text: Column, seed: Column, phrases: list[str], glue: str) -> Column:
    """One phrase per word of ``text``."""
    table, n = lit_array(phrases), len(phrases)
    return F.array_join(
        F.transform(
            F.split(text, " "),
            lambda w, i: F.get(table, F.pmod(F.length(w) * 5 + i * 7 + seed, F.lit(n)).cast("int")),
        ),
        glue,
    )


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items: list[str]) -> str:
    return "[" + ", ".join(quote(x) for x in items) + "]"


def sql_derive(phrases: list[str], glue: str) -> str:
    glue_sql = "chr(10)" if glue == "\n" else quote(glue)
    return (
        f"array_to_string(list_transform(string_split(text, ' '), lambda w, i: {sql_list(phrases)}"
        f"[1 + (length(w) * 5 + (i - 1) * 7 + turn) % {len(phrases)}]), {glue_sql})"
    )


def talk(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with the given text and the three derived ones; unused columns are pruned."""
    raw = read(spark, sf, "conversations")
    text, turn = F.col("text"), F.col("turn")
    base = raw.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"),
        F.col("role").alias("speaker"), F.col("text").alias("raw"),
        derive(text, turn, ENGLISH, " ").alias("en"),
        derive(text, turn, MARATHI, " ").alias("mr"),
        derive(text, turn, NOTE_LINES, "\n").alias("note_text"),
    )
    return T.with_roles(base, CLINICIANS)


TALK = f"""talk AS (
  SELECT conv_id AS session_id, turn AS turn_id, role AS speaker, text AS raw,
    CASE WHEN lower(role) IN ('assistant', 'system') THEN 'Doctor' ELSE 'Patient' END AS role,
    {sql_derive(ENGLISH, ' ')} AS en,
    {sql_derive(MARATHI, ' ')} AS mr,
    {sql_derive(NOTE_LINES, chr(10))} AS note_text
  FROM conversations)"""

BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in text_functions.BLANKS)
# Lines between any of the ends of a line; each query's SQL reads ``\\s`` as Unicode white space.
LINES_ANY = f"SELECT {{0}}, unnest(string_split_regex({{1}}, '{text_functions.LINE_END.replace('{', '{{').replace('}', '}}')}')) AS line, generate_subscripts(string_split_regex({{1}}, '{text_functions.LINE_END.replace('{', '{{').replace('}', '}}')}'), 1) - 1 AS line_no FROM {{2}}"


def odd_blanks(text: Column) -> Column:
    """The text with line and paragraph blanks of Unicode in place of some plain ones."""
    spaced = F.replace(F.replace(text, F.lit(", "), F.lit(",\u2028")), F.lit(" the "), F.lit("\u00a0the\u3000"))
    return F.replace(spaced, F.lit(" and "), F.lit("\x85and\x0b"))


def sql_odd_blanks(expr: str) -> str:
    return (
        f"replace(replace(replace({expr}, ', ', ',' || chr(8232)), ' the ', chr(160) || 'the' || chr(12288)),"
        " ' and ', chr(133) || 'and' || chr(11))"
    )


# Words of a text, split at white space.
SQL_WORDS = "list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> '')"
SQL_NORM = "trim(regexp_replace(lower({0}), '[^0-9a-z\\x{{0900}}-\\x{{097F}}]+', ' ', 'g'))"


def sql_words(expr: str) -> str:
    return SQL_WORDS.format(expr)


def sql_norm(expr: str) -> str:
    return SQL_NORM.format(expr)


def sql_tokens(expr: str) -> str:
    return f"list_filter(string_split({sql_norm(expr)}, ' '), lambda w: w <> '')"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {BLANKS_SQL})"


def sql_band(score: str, names: list[str], unknown: str = "'unknown'") -> str:
    arms = " ".join(
        f"WHEN {score} <= {hi} THEN {quote(n)}" for hi, n in zip(scores.BAND_LIMITS, names)
    )
    return f"CASE WHEN {score} IS NULL THEN {unknown} {arms} ELSE {quote(names[-1])} END"


def timed(spark: SparkSession, sf: str) -> DataFrame:
    """Turns timed at 0.4 s per word."""
    return T.timed_by_words(talk(spark, sf).withColumn("text_en", F.col("raw"))).select(
        "session_id", "turn_id", "speaker", "role", "text_en", "start_time", "stop_time"
    )


TIMED = f"""words AS (
  SELECT session_id, turn_id, speaker, role, raw AS text_en,
    len({sql_words('raw')}) AS w FROM talk),
timed AS (
  SELECT *, round((sum(w) OVER (PARTITION BY session_id ORDER BY turn_id) - w) * 0.4::DOUBLE, 3) AS start_time,
    round((sum(w) OVER (PARTITION BY session_id ORDER BY turn_id)) * 0.4::DOUBLE, 3) AS stop_time
  FROM words)"""


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in scores: one label row for six sessions out of seven."""
    sid = F.col("session_id")
    return (
        read(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
        .filter(sid % 7 != 0)
        .select(
            "session_id", (sid % 25).cast("int").alias("phq8_score"),
            F.when(sid % 25 >= 10, 1).otherwise(0).alias("phq8_binary"),
            (sid % 3).cast("int").alias("gender"),
            F.when(sid % 10 < 8, "train").when(sid % 10 == 8, "dev").otherwise("test").alias("split"),
        )
    )


LABELS = """lab AS (
  SELECT DISTINCT conv_id AS session_id, CAST(conv_id % 25 AS INTEGER) AS phq8_score,
    CASE WHEN conv_id % 25 >= 10 THEN 1 ELSE 0 END AS phq8_binary,
    CAST(conv_id % 3 AS INTEGER) AS gender,
    CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split
  FROM conversations WHERE conv_id % 7 <> 0)"""


def master(spark: SparkSession, sf: str) -> DataFrame:
    """Turns in three styles with their labels, the flat shape of the final dataset."""
    t = talk(spark, sf).select("session_id", "turn_id", "speaker", "role", "raw", "en", "mr")
    styled = T.style_variants(
        t.withColumn("text_en", F.col("en")).withColumn("text", F.col("mr")).drop("raw", "en", "mr"),
        VOCABULARY,
    )
    return T.master_rows(
        T.join_labels(
            T.expand_variants(styled, language=["marathi"])
            .withColumn("start_time", F.col("turn_id") * 1.0)
            .withColumn("stop_time", F.col("turn_id") * 1.0 + 0.5),
            labels(spark, sf),
        )
    )


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn's text as a prediction of the next turn's text."""
    raw = read(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "text"
    )
    nxt = raw.select("session_id", (F.col("turn_id") - 1).alias("turn_id"), F.col("text").alias("ref"))
    return raw.withColumnRenamed("text", "pred").join(nxt, ["session_id", "turn_id"])


PAIRS = """pairs AS (
  SELECT a.conv_id AS session_id, a.turn AS turn_id, a.text AS pred, b.text AS ref
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""


def section_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs spread over the four sections."""
    from parlance.functions.sections import SECTIONS

    return pairs(spark, sf).withColumn(
        "section", F.get(lit_array(SECTIONS), F.pmod("turn_id", F.lit(4)).cast("int"))
    )


SECTION_PAIRS = f"""{PAIRS},
spairs AS (SELECT *, ['subjective', 'objective', 'assessment', 'plan'][1 + turn_id % 4] AS section FROM pairs)"""


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """One two-language note per turn, some sections empty, short or in the wrong script."""
    t = talk(spark, sf)
    tid = F.col("turn_id")
    empty = F.lit("")
    return t.select(
        "session_id", "turn_id",
        (F.col("session_id") % 25).cast("int").alias("phq8_score"),
        F.struct(
            F.col("raw").alias("subjective"),
            F.when(tid % 2 == 0, F.col("en")).otherwise(empty).alias("objective"),
            F.when(tid % 3 == 0, empty)
            .otherwise(F.concat(F.lit("severity "), scores.band(F.col("session_id") % 25,
                       scores.EXPECTED_WORDS, None))).alias("assessment"),
            F.when(F.col("speaker") == "user", F.lit("ok")).otherwise(F.col("raw")).alias("plan"),
        ).alias("english"),
        F.struct(
            F.col("mr").alias("subjective"), empty.alias("objective"),
            F.when(tid % 2 == 1, F.col("raw")).otherwise(F.col("mr")).alias("assessment"),
            F.when(tid % 4 == 0, F.col("mr")).otherwise(empty).alias("plan"),
        ).alias("marathi"),
    )


NOTES = f"""notes AS (
  SELECT session_id, turn_id, CAST(session_id % 25 AS INTEGER) AS phq8_score,
    raw AS e_subjective, CASE WHEN turn_id % 2 = 0 THEN en ELSE '' END AS e_objective,
    CASE WHEN turn_id % 3 = 0 THEN '' ELSE 'severity ' ||
      ({sql_band('session_id % 25', scores.EXPECTED_WORDS)}) END AS e_assessment,
    CASE WHEN speaker = 'user' THEN 'ok' ELSE raw END AS e_plan,
    mr AS m_subjective, '' AS m_objective,
    CASE WHEN turn_id % 2 = 1 THEN raw ELSE mr END AS m_assessment,
    CASE WHEN turn_id % 4 = 0 THEN mr ELSE '' END AS m_plan
  FROM talk)"""


def seconds_of(ts: Column) -> Column:
    """Seconds since 1970 of a zone-less time stamp, whatever the session time zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
    whole = ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60
    return whole.cast("double") + F.extract(F.lit("SECOND"), ts).cast("double")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as speech chunks: per user, up to two minutes from each event's time stamp."""
    e = read(spark, sf, "events")
    at = F.round(seconds_of(F.col("ts")) - 1704067200.0, 3)
    return e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("chunk_id"),
        at.alias("start_s"), F.round(at + F.pmod("event_id", F.lit(7200)) + 60, 3).alias("end_s"),
        F.col("event_type").alias("speaker"),
        F.get(lit_array(ENGLISH), F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(len(ENGLISH)))
              .cast("int")).alias("text"),
    )


CHUNKS = f"""chunks AS (
  SELECT user_id AS session_id, event_id AS chunk_id,
    round(epoch_us(ts) / 1e6 - 1704067200.0, 3) AS start_s,
    round(round(epoch_us(ts) / 1e6 - 1704067200.0, 3) + event_id % 7200 + 60, 3) AS end_s,
    event_type AS speaker,
    {sql_list(ENGLISH)}[1 + (event_id * 7 + user_id) % {len(ENGLISH)}] AS text
  FROM events)"""


def patients(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as patients, first seen on a date that follows from their key."""
    c = read(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"),
        F.col("c_nationkey").alias("age"), F.col("c_mktsegment").alias("gender"),
        (F.col("c_custkey") % 997).alias("created_at"),
    )


PATIENTS = """patients AS (
  SELECT c_custkey AS id, c_name AS full_name, c_nationkey AS age, c_mktsegment AS gender,
    c_custkey % 997 AS created_at FROM customer)"""


def visits(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("visit_id"), F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("source_type"),
    )


VISITS = """visits AS (
  SELECT o_orderkey AS visit_id, o_custkey AS patient_id, o_orderdate AS created_at,
    o_orderpriority AS source_type FROM orders)"""
