"""Queries for projections, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.functions import rules, scores, sections, spans, text
from parlance.functions.rows import explode_rows, inline_rows
from parlance.operators import clinic, turns as T
from parlance.plans import tables as B
from parlance.plans.registry import query
from parlance.plans.tables import quote

KEY = "session_id, turn_id"


def sql_replace(expr: str, pairs) -> str:
    for old, new in pairs:
        if old != new:
            expr = f"replace({expr}, {quote(old)}, {quote(new)})"
    return expr


def sql_any(expr: str, marks) -> str:
    return "(" + " OR ".join(f"contains({expr}, {quote(m)})" for m in marks) + ")"


def sql_share(expr: str, body: str) -> str:
    return f"length(regexp_replace({expr}, '[^{body}]+', '', 'g'))"


DETECT = (
    "CASE WHEN {0} = '' THEN 'english' "
    "WHEN " + sql_share("{0}", "\\x{{0900}}-\\x{{097F}}") + " / greatest(length({0}), 1) > 0.3 "
    "THEN CASE WHEN contains({0}, 'ळ') OR contains({0}, 'ऱ') THEN 'marathi' ELSE 'hindi' END "
    "WHEN " + sql_share("{0}", "A-z") + " / greatest(length({0}), 1) > 0.5 THEN 'english' "
    "ELSE 'mixed' END"
)
ASCII = "\\x00-\\x7F"


@query("phq8_severity", f"""WITH {B.LABELS} SELECT session_id, phq8_score,
  {B.sql_band('phq8_score', scores.BAND_NAMES)} AS severity,
  {B.sql_band('phq8_score', scores.BAND_TITLES)} AS title FROM
  (SELECT c.session_id, phq8_score FROM (SELECT DISTINCT conv_id AS session_id FROM conversations) c
   LEFT JOIN lab USING (session_id))""")
def phq8_severity(spark, sf):
    ids = B.read(spark, sf, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    s = F.col("phq8_score")
    return ids.join(B.labels(spark, sf), "session_id", "left").select(
        "session_id", "phq8_score", scores.band(s).alias("severity"),
        scores.band(s, scores.BAND_TITLES).alias("title"),
    )


@query("role_map", f"WITH {B.TALK} SELECT {KEY}, speaker, role FROM talk")
def role_map(spark, sf):
    return B.talk(spark, sf).select("session_id", "turn_id", "speaker", "role")


@query("role_side", f"""WITH {B.TALK}, r AS (SELECT {KEY},
  CASE speaker WHEN 'system' THEN 'थेरपिस्ट' WHEN 'user' THEN 'रुग्ण ' || turn_id
  ELSE 'The ' || role END AS who FROM talk)
  SELECT {KEY}, who, CASE WHEN {sql_any('lower(who)', scores.PATIENT_WORDS)} THEN 'patient'
  WHEN {sql_any('lower(who)', scores.CLINICIAN_WORDS)} THEN 'doctor' ELSE 'patient' END AS side FROM r""")
def role_side(spark, sf):
    who = (
        F.when(F.col("speaker") == "system", "थेरपिस्ट")
        .when(F.col("speaker") == "user", F.concat(F.lit("रुग्ण "), F.col("turn_id").cast("string")))
        .otherwise(F.concat(F.lit("The "), F.col("role")))
    )
    return B.talk(spark, sf).select(
        "session_id", "turn_id", who.alias("who"), scores.side_of(who).alias("side")
    )


@query("role_label", f"""WITH {B.TALK} SELECT {KEY}, language,
  CASE language {' '.join(
      f"WHEN '{k}' THEN CASE WHEN role = 'Doctor' THEN '{v['Doctor']}' ELSE '{v['Patient']}' END"
      for k, v in rules.LANGUAGES.items())} END AS role_label
  FROM talk, (VALUES ('hindi'), ('marathi')) v(language)""")
def role_label(spark, sf):
    both = T.expand_variants(B.talk(spark, sf), language=list(rules.LANGUAGES))
    return both.select(
        "session_id", "turn_id", "language",
        rules.role_label(F.col("role"), F.col("language")).alias("role_label"),
    )


@query("turn_metrics", f"""WITH {B.TALK}, {B.TIMED}, raw_times AS (SELECT session_id, turn_id, text_en, w,
  CASE WHEN turn_id = 3 THEN 'n/a' ELSE CAST(start_time AS VARCHAR) END AS a,
  CAST(CASE WHEN turn_id = 4 THEN -1.0 ELSE stop_time END AS VARCHAR) AS b FROM timed),
  num AS (SELECT *, TRY_CAST(a AS DOUBLE) IS NULL OR TRY_CAST(b AS DOUBLE) IS NULL AS bad FROM raw_times),
  t AS (SELECT *, CASE WHEN bad THEN 0.0::DOUBLE ELSE TRY_CAST(a AS DOUBLE) END AS s,
    CASE WHEN bad THEN 0.0::DOUBLE ELSE TRY_CAST(b AS DOUBLE) END AS e FROM num)
  SELECT session_id, turn_id, round(s, 3) AS start_time, round(e, 3) AS stop_time,
    CAST(w AS INTEGER) AS word_count, round(greatest(e - s, 0.0), 3) AS duration_sec FROM t""")
def turn_metrics(spark, sf):
    t = B.timed(spark, sf)
    dirty = t.withColumn(
        "start_time", F.when(F.col("turn_id") == 3, "n/a").otherwise(F.col("start_time").cast("string"))
    ).withColumn(
        "stop_time",
        F.when(F.col("turn_id") == 4, F.lit(-1.0)).otherwise(F.col("stop_time")).cast("string"),
    )
    return T.with_metrics(dirty).select(
        "session_id", "turn_id", "start_time", "stop_time", "word_count", "duration_sec"
    )


@query("safe_label_cast", """WITH r AS (SELECT conv_id AS session_id, turn AS turn_id,
  CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN (conv_id % 25) || '.7' WHEN 2 THEN NULL ELSE 'bad' END AS a,
  CASE turn % 3 WHEN 0 THEN CAST(conv_id % 20 AS VARCHAR) ELSE '' END AS b,
  CASE turn % 3 WHEN 0 THEN ' 1 ' WHEN 1 THEN '' ELSE '1.5' END AS c FROM conversations)
  SELECT session_id, turn_id,
    CAST(trunc(TRY_CAST(coalesce(nullif(a, ''), nullif(b, '')) AS DOUBLE)) AS INTEGER) AS phq8_score,
    CASE WHEN regexp_full_match(trim(c), '[+-]?[0-9]+') THEN CAST(trim(c) AS INTEGER) END AS phq8_binary
  FROM r""")
def safe_label_cast(spark, sf):
    raw = B.read(spark, sf, "conversations")
    sid, tid = F.col("conv_id"), F.col("turn")
    a = (
        F.when(tid % 4 == 0, "").when(tid % 4 == 1, F.concat((sid % 25).cast("string"), F.lit(".7")))
        .when(tid % 4 == 2, F.lit(None).cast("string")).otherwise("bad")
    )
    b = F.when(tid % 3 == 0, (sid % 20).cast("string")).otherwise("")
    c = F.when(tid % 3 == 0, " 1 ").when(tid % 3 == 1, "").otherwise("1.5")
    return raw.select(
        sid.alias("session_id"), tid.alias("turn_id"),
        scores.score_of(a, b).alias("phq8_score"), scores.int_of(c).alias("phq8_binary"),
    )


@query("gender_label", f"""WITH {B.LABELS} SELECT session_id, gender,
  CASE gender WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender_name FROM lab""")
def gender_label(spark, sf):
    return B.labels(spark, sf).select(
        "session_id", "gender", scores.gender_label(F.col("gender"), B.GENDERS).alias("gender_name")
    )


@query("text_normalise", f"""SELECT doc_id, {B.sql_norm('text')} AS normal,
  CAST(len({B.sql_tokens('text')}) AS INTEGER) AS n_tokens FROM documents""")
def text_normalise(spark, sf):
    return B.read(spark, sf, "documents").select(
        "doc_id", text.normalise(F.col("text")).alias("normal"),
        F.size(text.tokens(F.col("text"))).alias("n_tokens"),
    )


@query("detect_language", f"""WITH {B.TALK} SELECT 'd' || doc_id AS id, {DETECT.format('text')} AS language FROM documents
  UNION ALL SELECT 't' || session_id || '_' || turn_id || '_' || k, {DETECT.format('x')} FROM (
    SELECT {KEY}, 'mr' AS k, mr AS x FROM talk UNION ALL SELECT {KEY}, 'both', mr || ' ' || raw FROM talk
    UNION ALL SELECT {KEY}, 'num', regexp_replace(en, '[a-zA-Z]+', '12', 'g') FROM talk)""")
def detect_language(spark, sf):
    docs = B.read(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("x")
    )
    said = B.talk(spark, sf).select(
        F.concat_ws("_", F.concat(F.lit("t"), F.col("session_id")), "turn_id").alias("id"),
        F.explode(F.create_map(
            F.lit("mr"), F.col("mr"), F.lit("both"), F.concat("mr", F.lit(" "), "raw"),
            F.lit("num"), F.regexp_replace("en", "[a-zA-Z]+", "12"),
        )).alias("k", "x"),
    ).select(F.concat_ws("_", "id", "k").alias("id"), "x")
    return docs.unionByName(said).select("id", text.detect_language(F.col("x")).alias("language"))


@query("latin_ratio", f"""WITH x AS (SELECT doc_id, {sql_share('text', ASCII)} / greatest(length(text), 1) AS r FROM documents)
  SELECT doc_id, round(r, 6) AS ratio, r > 0.7 AS mostly_english, r > 0.3 AS too_latin FROM x""")
def latin_ratio(spark, sf):
    c = F.col("text")
    return B.read(spark, sf, "documents").select(
        "doc_id", F.round(text.latin_ratio(c), 6).alias("ratio"),
        text.mostly_english(c).alias("mostly_english"), (text.latin_ratio(c) > 0.3).alias("too_latin"),
    )


@query("dialect_rewrite", f"WITH {B.TALK} SELECT {KEY}, dialect, text FROM (" + " UNION ALL ".join(
    f"SELECT {KEY}, '{d}' AS dialect, {sql_replace('mr', r)} AS text FROM talk"
    for d, r in rules.DIALECT_RULES.items()) + ")")
def dialect_rewrite(spark, sf):
    said = B.talk(spark, sf).select("session_id", "turn_id", F.col("mr").alias("text"))
    return T.dialect_variants(said).select("session_id", "turn_id", "dialect", "text")


@query("colloquial_rewrite", f"WITH {B.TALK} SELECT {KEY}, {sql_replace('mr', rules.SPOKEN_RULES)} AS text FROM talk")
def colloquial_rewrite(spark, sf):
    return B.talk(spark, sf).select("session_id", "turn_id", rules.to_spoken(F.col("mr")).alias("text"))


@query("slang_rewrite", f"WITH {B.TALK} SELECT {KEY}, {sql_replace('mr', rules.SLANG_RULES)} AS text FROM talk")
def slang_rewrite(spark, sf):
    return B.talk(spark, sf).select("session_id", "turn_id", rules.to_slang(F.col("mr")).alias("text"))


@query("gender_rewrite", f"""WITH {B.TALK}, g AS (SELECT *, CASE session_id % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'male' END AS gender FROM talk)
  SELECT {KEY}, gender, CASE WHEN role = 'Patient' AND gender = 'male' THEN {sql_replace('mr', rules.MALE_RULES)}
  WHEN role = 'Patient' AND gender = 'female' THEN {sql_replace('mr', rules.FEMALE_RULES)} ELSE mr END AS text FROM g""")
def gender_rewrite(spark, sf):
    gender = scores.gender_label(F.col("session_id") % 3, B.GENDERS)
    return B.talk(spark, sf).select(
        "session_id", "turn_id", gender.alias("gender"),
        rules.to_gender(F.col("mr"), F.col("role"), gender).alias("text"),
    )


def sql_draw(salt: str) -> str:
    return f"(('0x' || left(md5(session_id || '_' || turn_id || ':{salt}:42'), 7))::BIGINT / 268435456.0::DOUBLE)"


def sql_pick(items: list[str], salt: str) -> str:
    return f"{B.sql_list(items)}[1 + floor({sql_draw(salt)} * {len(items)})::BIGINT]"


def _sql_fillers() -> str:
    parts = []
    for d in rules.DIALECTS:
        t = sql_replace("mr", rules.DIALECT_RULES[d])
        if d not in rules.DIALECT_FILLERS:
            parts.append(f"SELECT {KEY}, '{d}' AS dialect, role, {t} AS text FROM talk")
            continue
        chance, items = rules.DIALECT_FILLERS[d]
        f = sql_pick(items, f"{d}-word")
        parts.append(
            f"SELECT {KEY}, '{d}' AS dialect, role, CASE WHEN role = 'Patient' AND length(t) >= 15 AND {sql_draw(d + '-chance')} <= {chance} THEN "
            f"CASE WHEN {sql_draw(d + '-side')} < 0.5 THEN {f} || ', ' || t ELSE t || ' ' || {f} END ELSE t END AS text FROM (SELECT *, {t} AS t FROM talk)"
        )
    f = sql_pick(rules.PATIENT_FILLERS, "spoken-p")
    said = sql_replace(sql_replace("mr", rules.SPOKEN_RULES), rules.SLANG_RULES)
    gendered = (f"CASE WHEN role = 'Patient' AND session_id % 3 = 1 THEN {sql_replace('s', rules.MALE_RULES)} "
                f"WHEN role = 'Patient' AND session_id % 3 = 0 THEN {sql_replace('s', rules.FEMALE_RULES)} ELSE s END")
    parts.append(
        f"SELECT {KEY}, 'spoken', role, CASE WHEN role = 'Patient' AND length(t) >= 20 AND {sql_draw('spoken-chance')} <= 0.1 THEN "
        f"CASE WHEN {sql_draw('spoken-side')} > 0.5 THEN {f} || ', ' || t WHEN cut > 0 THEN left(t, cut) || ' ' || {f} || ', ' || trim(substr(t, cut + 1)) ELSE t END ELSE t END "
        f"FROM (SELECT *, length(regexp_extract(t, '^[^,।.]*[,।.]')) AS cut FROM (SELECT *, {gendered} AS t FROM (SELECT *, {said} AS s FROM talk)))"
    )
    return " UNION ALL ".join(parts)


@query("filler_injection", f"WITH {B.TALK} {_sql_fillers()}")
def filler_injection(spark, sf):
    """Dialect fillers and conversational fillers, drawn from each turn's key."""
    said = B.talk(spark, sf).select(
        "session_id", "turn_id", "role", F.col("mr").alias("text"),
        scores.gender_label(F.col("session_id") % 3, B.GENDERS).alias("gender"),
    )
    cols = ["session_id", "turn_id", "dialect", "role", "text"]
    regional = T.dialect_variants(said, fillers=True)
    spoken = T.spoken_style(said, fillers=True).withColumn("dialect", F.lit("spoken"))
    return regional.select(*cols).unionByName(spoken.select(*cols))


def _sql_plain(expr: str) -> str:
    for pattern, wording in rules.PLAIN_ENGLISH:
        expr = f"regexp_replace({expr}, {quote(pattern)}, {quote(wording)}, 'gi')"
    return expr


@query("simplify_english", f"WITH {B.TALK} SELECT {KEY}, {_sql_plain('lower(en)')} AS text FROM talk")
def simplify_english(spark, sf):
    return B.talk(spark, sf).select("session_id", "turn_id", rules.to_plain_english(F.col("en")).alias("text"))


def _sql_vocabulary(expr: str) -> str:
    out = expr
    for key, forms in B.VOCABULARY.items():
        wording = forms.get("colloquial") or forms.get("formal") or ""
        if key.startswith("_") or not wording:
            continue
        p = quote(f"\\b{key}\\b")
        out = (f"CASE WHEN regexp_matches(lower({expr}), {p}) THEN "
               f"regexp_replace({out}, {p}, {quote(wording)}, 'gi') ELSE {out} END")
    return out


@query("vocab_substitute", f"WITH {B.TALK} SELECT {KEY}, {_sql_vocabulary('en')} AS text FROM talk")
def vocab_substitute(spark, sf):
    return B.talk(spark, sf).select(
        "session_id", "turn_id", rules.substitute_vocabulary(F.col("en"), B.VOCABULARY).alias("text")
    )


@query("code_mix", f"""WITH {B.TALK}, parts AS (
    SELECT {KEY}, mr, unnest(string_split(en, ' ')) AS x, generate_subscripts(string_split(en, ' '), 1) AS i FROM talk),
  pieces AS (SELECT {KEY}, i // 4 AS piece, string_agg(x, ' ' ORDER BY i) AS en,
      CASE WHEN (i // 4) % 5 = 0 THEN '' ELSE any_value(mr) END AS mr
    FROM parts GROUP BY {KEY}, i // 4),
  w AS (SELECT *, {B.sql_words('en')} AS ws FROM pieces),
  k AS (SELECT *, list_filter(ws, lambda x: list_contains({B.sql_list(rules.CODE_MIX_KEEP)},
     lower(regexp_replace(x, '[^a-zA-Z]', '', 'g')))) AS ks FROM w)
  SELECT {KEY}, CAST(piece AS BIGINT) AS piece, CASE WHEN len(ks) = 0 THEN coalesce(nullif(mr, ''), en)
    WHEN len(ks) = len(ws) THEN en
    WHEN len(ks) <= 2 THEN coalesce(nullif(mr, ''), en) || ' (' || array_to_string(ks, ' ') || ')'
    ELSE coalesce(nullif(mr, ''), en) END AS text FROM k""")
def code_mix(spark, sf):
    """Four-word pieces of each turn, so that every branch is met."""
    pieces = explode_rows(
        B.talk(spark, sf).withColumn("_w", F.split("en", " ")), ["session_id", "turn_id", "mr"],
        F.transform(
            F.sequence(F.lit(0), F.floor(F.size("_w") / 4).cast("int")),
            lambda p: F.array_join(F.slice("_w", F.greatest(p * 4, F.lit(1)),
                                           F.when(p == 0, 3).otherwise(4)), " "),
        ),
        "en", "piece",
    ).filter((F.col("en") != "") | (F.col("piece") == 0))
    mr = F.when(F.col("piece") % 5 == 0, "").otherwise(F.col("mr"))
    return pieces.select(
        "session_id", "turn_id", F.col("piece").cast("long").alias("piece"),
        text.code_mix(F.col("en"), mr, rules.CODE_MIX_KEEP).alias("text"),
    )


def _sql_terms(expr: str) -> str:
    for english, local in rules.NOTE_TERMS:
        for form in (english, english.capitalize(), english.upper()):
            expr = f"replace({expr}, {quote(form)}, {quote(local)})"
    return expr


@query("term_translate", f"WITH {B.TALK} SELECT {KEY}, {_sql_terms('en')} AS text FROM talk")
def term_translate(spark, sf):
    return B.talk(spark, sf).select("session_id", "turn_id", rules.translate_terms(F.col("en")).alias("text"))


LINES = "SELECT {0}, unnest(string_split({1}, chr(10))) AS line, generate_subscripts(string_split({1}, chr(10)), 1) - 1 AS line_no FROM {2}"


@query("line_translate_route", f"""WITH {B.TALK}, l AS ({LINES.format(KEY, 'note_text', 'talk')}),
  m AS (SELECT *, {B.sql_strip('line')} = '' AS blank, {sql_replace('line', [(f, m) for e, m in rules.NOTE_TERMS for f in (e, e.capitalize(), e.upper())])} AS t FROM l)
  SELECT {KEY}, CAST(line_no AS INTEGER) AS line_no, CASE WHEN blank THEN line ELSE t END AS line,
    NOT blank AND {sql_share('t', ASCII)} / greatest(length(t), 1) > 0.7 AS needs_model FROM m""")
def line_translate_route(spark, sf):
    lines = explode_rows(
        B.talk(spark, sf), ["session_id", "turn_id"], F.split("note_text", "\n"), "line", "line_no"
    )
    blank = text.is_blank(F.col("line"))
    done = lines.withColumn("_t", rules.translate_terms_in_line(F.col("line")))
    return done.select(
        "session_id", "turn_id", "line_no",
        F.when(blank, F.col("line")).otherwise(F.col("_t")).alias("line"),
        (~blank & text.mostly_english(F.col("_t"))).alias("needs_model"),
    )


@query("clean_asr_text")
def clean_asr_text(spark, sf):
    """Stuck speech built from the given texts: a stuck letter, word and phrase each."""
    c = F.col("text")
    w = text.words(c)
    first = F.get(w, 0)
    phrase = F.array_join(F.slice(w, 1, 2), " ")
    stuck = F.concat_ws(
        " ", F.concat(F.lit("um"), F.repeat(F.lit("m"), 9)), F.repeat(F.concat(first, F.lit(" ")), F.lit(7)),
        c, F.repeat(F.concat(phrase, F.lit(" ")), F.lit(5)),
    )
    return B.read(spark, sf, "documents").select("doc_id", text.clean_asr_text(stuck).alias("text"))


def _sql_loops() -> str:
    head = "CASE WHEN n < 6 THEN t WHEN w[1:n // 2] = w[n // 2 + 1:2 * (n // 2)] THEN array_to_string(w[1:n // 2], ' ')"
    for s in (3, 4, 5, 6):
        same = " AND ".join(f"w[{1 + k * s}:{(k + 1) * s}] = w[1:{s}]" for k in (1, 2, 3))
        head += f" WHEN n >= {4 * s} AND {same} THEN array_to_string(w[1:{s}], ' ')"
    return head + " ELSE t END"


LOOP_MAKERS_SQL = """CASE doc_id % 4
  WHEN 0 THEN text || ' ' || text
  WHEN 1 THEN repeat(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1:(3 + doc_id % 4)::BIGINT], ' ') || ' ', 5) || text
  WHEN 2 THEN '. . . . . . .' || text || ' ------- ' ELSE text END"""


def _loopy(c, key):
    head = F.array_join(F.slice(text.words(c), F.lit(1), (3 + key % 4).cast("int")), " ")
    return (
        F.when(key % 4 == 0, F.concat(c, F.lit(" "), c))
        .when(key % 4 == 1, F.concat(F.repeat(F.concat(head, F.lit(" ")), F.lit(5)), c))
        .when(key % 4 == 2, F.concat(F.lit(". . . . . . ."), c, F.lit(" ------- ")))
        .otherwise(c)
    )


@query("collapse_loops", f"""WITH r AS (SELECT doc_id, {LOOP_MAKERS_SQL} AS x FROM (SELECT doc_id, {B.sql_odd_blanks('text')} AS text FROM documents)),
  c AS (SELECT doc_id, {B.sql_strip("regexp_replace(" + B.sql_strip("regexp_replace(x, '([.·•-]\\s*){6,}', '', 'g')") + ", '\\s{2,}', ' ', 'g')")} AS t FROM r),
  s AS (SELECT *, {B.sql_words('t')} AS w FROM c), q AS (SELECT *, len(w) AS n FROM s)
  SELECT doc_id, {_sql_loops()} AS text FROM q""")
def collapse_loops(spark, sf):
    docs = B.read(spark, sf, "documents")
    return docs.select("doc_id", text.collapse_loops(_loopy(B.odd_blanks(F.col("text")), F.col("doc_id"))).alias("text"))


@query("low_info_filter", f"""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text
    WHEN 1 THEN repeat(text || ' ', (1 + doc_id % 6)::BIGINT) ELSE regexp_replace(text, '[\\p{{L}}\\p{{N}}_'']+', 'uh', 'g') END AS x FROM documents),
  t AS (SELECT doc_id, regexp_extract_all(lower(x), '([\\p{{L}}\\p{{N}}_'']+)', 1) AS w FROM r),
  e AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t),
  b AS (SELECT *, CASE WHEN tok = lag(tok) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS brk FROM e),
  g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
  m AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, run, count(*) AS c FROM g GROUP BY ALL) GROUP BY doc_id)
  SELECT doc_id, CASE WHEN len(w) = 0 THEN true WHEN len(w) < 8 THEN false
    ELSE longest >= 7 OR len(list_distinct(w)) / len(w) < 0.2 END AS low_info FROM t LEFT JOIN m USING (doc_id)""")
def low_info_filter(spark, sf):
    c, k = F.col("text"), F.col("doc_id")
    x = (
        F.when(k % 3 == 0, c)
        .when(k % 3 == 1, F.repeat(F.concat(c, F.lit(" ")), (1 + k % 6).cast("int")))
        .otherwise(F.regexp_replace(c, r"[\p{L}\p{N}_']+", "uh"))
    )
    return B.read(spark, sf, "documents").select("doc_id", text.is_low_info(x).alias("low_info"))


@query("validate_transcript", f"""SELECT doc_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS transcript
  FROM (SELECT doc_id, {B.sql_odd_blanks('text')} AS x FROM documents) WHERE length({B.sql_strip('x')}) BETWEEN 3 AND 500""")
def validate_transcript(spark, sf):
    c = B.odd_blanks(F.col("text"))
    return B.read(spark, sf, "documents").filter(text.valid_clip_text(c)).select(
        "doc_id", text.squeeze(c).alias("transcript")
    )


SQL_QUESTION = "(contains({0}, '?') OR " + " OR ".join(f"contains({{0}}, '{c}')" for c in text.QUESTION_CUES) + ")"
SQL_BRIEF = ("(len(" + B.SQL_WORDS + f") <= {text.BRIEF_REPLY_WORDS} OR "
             + " OR ".join(f"starts_with({{0}}, '{c}')" for c in text.REPLY_OPENERS) + ")")


@query("question_cue", f"WITH {B.TALK} SELECT {KEY}, {SQL_QUESTION.format('lower(raw)')} AS raw_question, {SQL_QUESTION.format('lower(en)')} AS en_question FROM talk")
def question_cue(spark, sf):
    return B.talk(spark, sf).select(
        "session_id", "turn_id", text.is_question(F.col("raw")).alias("raw_question"),
        text.is_question(F.col("en")).alias("en_question"),
    )


@query("brief_reply", f"WITH {B.TALK} SELECT {KEY}, {SQL_BRIEF.format(B.sql_strip('lower(raw)'))} AS raw_brief, {SQL_BRIEF.format(B.sql_strip('lower(en)'))} AS en_brief FROM talk")
def brief_reply(spark, sf):
    return B.talk(spark, sf).select(
        "session_id", "turn_id", text.is_brief_reply(F.col("raw")).alias("raw_brief"),
        text.is_brief_reply(F.col("en")).alias("en_brief"),
    )


@query("prepare_conversation", f"""WITH d AS (SELECT doc_id, replace(replace({B.sql_odd_blanks('text')}, '. ', '.' || chr(10)), ' of ', ' : ') AS x FROM documents),
  l AS ({B.LINES_ANY.format('doc_id', 'x', 'd')}),
  s AS (SELECT doc_id, line_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM l),
  p AS (SELECT *, strpos(line, ':') AS c FROM s WHERE line <> ''),
  r AS (SELECT doc_id, line_no, CASE WHEN c = 0 THEN line
      WHEN length(trim(substr(line, c + 1))) >= 2 THEN trim(substr(line, 1, c - 1)) || ': ' || trim(substr(line, c + 1)) END AS line FROM p),
  k AS (SELECT *, regexp_replace(lower(line), '[^a-z0-9\\x{{0900}}-\\x{{097F}} ]+', '', 'g') AS key FROM r WHERE line IS NOT NULL),
  q AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS prev FROM k),
  j AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS m FROM q WHERE key <> prev GROUP BY doc_id)
  SELECT doc_id, CASE WHEN length(m) > 7000 THEN left(m, 3500) || chr(10) || '...[trimmed for length]...' || chr(10) || right(m, 3500)
    ELSE coalesce(m, '') END AS text FROM documents LEFT JOIN j USING (doc_id)""")
def prepare_conversation(spark, sf):
    odd = B.odd_blanks(F.col("text"))
    x = F.replace(F.replace(odd, F.lit(". "), F.lit(".\n")), F.lit(" of "), F.lit(" : "))
    return B.read(spark, sf, "documents").select("doc_id", sections.prepare_conversation(x).alias("text"))


def _sql_marks(low: str) -> str:
    arms = " ".join(
        f"WHEN {sql_any(low, sections.SECTION_MARKS[s])} THEN '{s}'" for s in sections.SECTIONS
    )
    return f"CASE {arms} END"


SECTION_COLS = ", ".join(
    f"coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE cur = '{s}' AND sec IS NULL), '') AS {s}"
    for s in sections.SECTIONS
)


@query("split_sections_simple", f"""WITH {B.TALK}, l0 AS ({LINES.format(KEY, 'note_text', 'talk')}),
  l AS (SELECT {KEY}, line_no, {B.sql_strip('line')} AS line FROM l0),
  m AS (SELECT *, {_sql_marks('lower(line)')} AS sec FROM l WHERE line <> ''),
  f AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY line_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM m)
  SELECT {KEY}, {SECTION_COLS} FROM f RIGHT JOIN (SELECT {KEY} FROM talk) USING ({KEY}) GROUP BY {KEY}""")
def split_sections_simple(spark, sf):
    return B.talk(spark, sf).select(
        "session_id", "turn_id", sections.split_sections_simple(F.col("note_text")).alias("n")
    ).select("session_id", "turn_id", "n.*")


BARE = "trim(lower(line), '*: ')"
SANITISE = f"""l0 AS ({B.LINES_ANY.format(KEY, 'x', 'src')}),
  l AS (SELECT {KEY}, line_no, {B.sql_strip('line')} AS line FROM l0),
  k AS (SELECT *, {B.sql_strip("regexp_replace(line, '^#{1,6}\\s*', '')")} AS b FROM l
    WHERE line <> '' AND {BARE} NOT IN ('subjective', 'objective', 'assessment', 'plan') AND NOT starts_with({BARE}, '```')),
  p AS (SELECT {KEY}, line_no, CASE WHEN starts_with(b, '-') THEN '- ' || {B.sql_strip("ltrim(b, '-')")}
    WHEN regexp_matches(b, '^[\\x{{0900}}-\\x{{097F}}A-Za-z][^\\n]{{2,120}}:$') THEN b ELSE '- ' || b END AS line FROM k),
  d AS (SELECT *, row_number() OVER (PARTITION BY {KEY}, regexp_replace(lower(line), '\\s+', ' ', 'g') ORDER BY line_no) AS rn FROM p)"""


@query("sanitise_section", f"""WITH {B.TALK}, src AS (SELECT {KEY},
    regexp_replace(regexp_replace(note_text, '\\s*#{{3,}}\\s*', chr(10), 'g'), '\\s+[•●]\\s*', chr(10) || '- ', 'g') AS x FROM talk),
  {SANITISE}
  SELECT {KEY}, coalesce(string_agg(line, chr(10) ORDER BY line_no), '') AS text
  FROM (SELECT * FROM d WHERE rn = 1) RIGHT JOIN (SELECT {KEY} FROM talk) USING ({KEY}) GROUP BY {KEY}""")
def sanitise_section(spark, sf):
    return B.talk(spark, sf).select(
        "session_id", "turn_id", sections.sanitise_section(F.col("note_text")).alias("text")
    )


def _sql_header(name: str) -> str:
    return f"(?:\\*\\*)?\\s*{name}\\s*:?\\s*(?:\\*\\*)?"


def _sql_robust() -> str:
    names = sections.SECTIONS
    starts = ", ".join(
        f"CASE WHEN regexp_matches(lower(x), '{_sql_header(n)}') THEN length(regexp_extract(lower(x), '(?s)^(.*?){_sql_header(n)}', 1)) END AS at_{n}"
        for n in names
    )
    chunks = " UNION ALL ".join(
        f"SELECT {KEY}, 'off_{n}' AS part, CASE WHEN at_{n} IS NULL THEN '' ELSE regexp_replace(substr(x, at_{n} + 1, coalesce(least("
        + ", ".join(f"CASE WHEN at_{o} > at_{n} THEN at_{o} END" for o in names if o != n)
        + f"), length(x)) - at_{n}), '(?i)^(?:\\*\\*)?\\s*{n}\\s*:?\\s*(?:\\*\\*)?\\s*', '') END AS x FROM offs WHERE k <> 1"
        for n in names
    )
    long_arms = " ".join(f"WHEN regexp_matches(line, '(?i)^{_sql_header(n)}') THEN '{n}'" for n in names)
    short_arms = " ".join(f"WHEN regexp_matches(line, {quote('(?i)' + p)}) THEN '{n}'" for n, p in sections.SHORT_HEADERS.items())
    by_line = " UNION ALL ".join(
        f"SELECT {KEY}, 'line_{n}', coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE cur = '{n}' AND sec IS NULL), '') FROM filled GROUP BY {KEY}"
        for n in names
    )
    key3 = f"{KEY}, part"
    sanitised = SANITISE.replace(KEY, key3)
    get = lambda part: f"coalesce(max(y) FILTER (WHERE part = '{part}'), '')"
    first = ", ".join(
        f"CASE WHEN any_value(k) = 1 THEN {get('json_' + n)} WHEN {get('off_' + n)} <> '' AND any_value(headed) THEN {get('off_' + n)} ELSE {get('line_' + n)} END AS {n}"
        for n in names
    )
    blank = " AND ".join(f"{n} = ''" for n in names)
    final = ", ".join(
        f"CASE WHEN {n} <> '' THEN {n}" + (f" WHEN k <> 1 AND {blank} AND whole <> '' THEN whole" if n == "subjective" else "")
        + f" ELSE '{sections.EMPTY_SECTION}' END AS {n}"
        for n in names
    )
    return f"""WITH {B.TALK}, body AS (SELECT {KEY}, turn_id % 3 AS k, CASE turn_id % 3 WHEN 0 THEN note_text ELSE raw END AS x, en, note_text FROM talk),
  offs AS (SELECT *, {starts} FROM body),
  l1 AS ({B.LINES_ANY.format(KEY, 'x', 'body WHERE k <> 1')}),
  l2 AS (SELECT {KEY}, line_no, {B.sql_strip('line')} AS line FROM l1),
  marked AS (SELECT *, CASE {long_arms} {short_arms} END AS sec FROM l2 WHERE line <> ''),
  filled AS (SELECT *, last_value(sec IGNORE NULLS) OVER (PARTITION BY {KEY} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cur FROM marked),
  parts AS ({chunks} UNION ALL {by_line} UNION ALL SELECT {KEY}, 'whole', x FROM body WHERE k <> 1
    UNION ALL SELECT {KEY}, 'json_subjective', en FROM body WHERE k = 1 UNION ALL SELECT {KEY}, 'json_plan', note_text FROM body WHERE k = 1),
  src AS (SELECT {key3}, regexp_replace(regexp_replace(x, '\\s*#{{3,}}\\s*', chr(10), 'g'), '\\s+[•●]\\s*', chr(10) || '- ', 'g') AS x FROM parts),
  {sanitised},
  clean AS (SELECT {key3}, {B.sql_strip("string_agg(line, chr(10) ORDER BY line_no)")} AS y FROM d WHERE rn = 1 GROUP BY {key3}),
  heads AS (SELECT {KEY}, k, coalesce({', '.join('at_' + n for n in names)}) IS NOT NULL AS headed FROM offs),
  wide AS (SELECT {KEY}, any_value(k) AS k, {get('whole')} AS whole, {first} FROM heads LEFT JOIN clean USING ({KEY}) GROUP BY {KEY})
  SELECT {KEY}, {final} FROM wide"""


@query("split_sections_robust", _sql_robust())
def split_sections_robust(spark, sf):
    """Headed notes, JSON notes and plain texts, by turn."""
    t, k = B.talk(spark, sf), F.col("turn_id") % 3
    body = F.to_json(F.struct(F.col("en").alias("subjective"), F.col("note_text").alias("plan")))
    source = F.when(k == 0, F.col("note_text")).when(
        k == 1, F.concat(F.lit("Here: "), body, F.lit(" done"))
    ).otherwise(F.col("raw"))
    return t.select(
        "session_id", "turn_id", sections.split_sections_robust(source).alias("n")
    ).select("session_id", "turn_id", "n.*")


@query("subsections_keypoints", f"""WITH {B.TALK}, src AS (SELECT {KEY},
    regexp_replace(regexp_replace(regexp_replace(replace(note_text, chr(13), chr(10)), '\\s*#{{1,6}}\\s*', chr(10), 'g'),
      '\\s+([^:\\n-][^:\\n]{{2,110}}:)\\s*-\\s+', chr(10) || '\\1' || chr(10) || '- ', 'g'), '\\s+-\\s+', chr(10) || '- ', 'g') AS x FROM talk),
  l0 AS ({LINES.format(KEY, 'x', 'src')}),
  l AS (SELECT {KEY}, line_no, {B.sql_strip('line')} AS line FROM l0),
  h AS (SELECT *, regexp_matches(line, '^[^:\\n-][^:\\n]{{2,120}}:$') AS head FROM l WHERE line <> ''),
  g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY line_no) AS grp FROM h),
  t AS (SELECT *, max(CASE WHEN head THEN line END) OVER (PARTITION BY {KEY}, grp) AS title FROM g),
  p AS (SELECT {KEY}, grp, line_no, coalesce(left(title, length(title) - 1), 'Key Clinical Points') AS title,
      {B.sql_strip("regexp_replace(line, '^-+\\s*', '')")} AS point FROM t WHERE NOT head),
  q AS (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY line_no) AS rn FROM p WHERE point <> ''),
  kp AS (SELECT {KEY}, string_agg(point, ' | ' ORDER BY line_no) AS key_points FROM q WHERE rn <= 3 GROUP BY {KEY}),
  s AS (SELECT {KEY}, grp, any_value(title) AS title, CAST(count(*) AS INTEGER) AS n_points, string_agg(point, chr(10) ORDER BY line_no) AS points FROM q GROUP BY {KEY}, grp)
  SELECT {KEY}, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY grp) - 1 AS INTEGER) AS sub_no, title, n_points, points, key_points
  FROM s JOIN kp USING ({KEY})""")
def subsections_keypoints(spark, sf):
    subs = B.talk(spark, sf).select(
        "session_id", "turn_id", sections.subsections(F.col("note_text")).alias("subs")
    )
    points = F.array_join(sections.key_points(F.col("subs")), " | ").alias("key_points")
    return explode_rows(subs, ["session_id", "turn_id", points], F.col("subs"), "s", "sub_no").select(
        "session_id", "turn_id", "sub_no", F.col("s.title").alias("title"),
        F.size("s.points").alias("n_points"), F.array_join("s.points", "\n").alias("points"), "key_points",
    )


def sql_matches(source: str, table: str, keys: str, patterns: list[tuple[int, str, str]]) -> str:
    """Rows (keys, rule, label, start, stop) of non-overlapping matches, by summed lengths."""
    parts = []
    for i, label, p in patterns:
        parts.append(
            f"SELECT {keys}, {i} AS rule, {quote(label)} AS label, string_split_regex({source}, {quote('(?i)' + p)}) AS gaps, "
            f"regexp_extract_all({source}, {quote('(?i)' + p)}) AS hits FROM {table} WHERE regexp_matches({source}, {quote('(?i)' + p)})"
        )
    return f"""found AS ({' UNION ALL '.join(parts)}),
  pos AS (SELECT {keys}, rule, label, unnest(hits) AS hit, generate_subscripts(hits, 1) AS k, gaps, hits FROM found),
  spans AS (SELECT {keys}, rule, label, hit,
    CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS INTEGER) AS start FROM pos),
  hitspans AS (SELECT *, start + CAST(length(hit) AS INTEGER) AS stop FROM spans)"""


@query("highlight_spans", f"""WITH {B.TALK}, mixed AS (SELECT {KEY}, replace(en || ' ' || mr, 'safety ', 'औषधउपचार ') AS x FROM talk),
  {sql_matches('x', 'mixed', KEY, [(i, 'H', p) for i, p in enumerate(spans.HIGHLIGHTS)])},
  o AS (SELECT *, max(stop) OVER (PARTITION BY {KEY} ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hitspans),
  g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY {KEY} ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS grp FROM o)
  SELECT {KEY}, min(start) AS start, max(stop) AS stop FROM g GROUP BY {KEY}, grp""")
def highlight_spans(spark, sf):
    x = F.replace(F.concat("en", F.lit(" "), "mr"), F.lit("safety "), F.lit("औषधउपचार "))
    return inline_rows(B.talk(spark, sf), ["session_id", "turn_id"], spans.highlight_spans(x))


def _sql_pack(key: str, table: str, source: str, sep: str, limit: int, glue: str) -> str:
    return f"""p AS (SELECT {key}, string_split({source}, {sep}) AS ps FROM {table}),
  step AS (SELECT {key}, ps, 1 AS i, ps[1] AS cur, 0 AS n, NULL::VARCHAR AS done FROM p
    UNION ALL SELECT {key}, ps, i + 1,
      CASE WHEN length(cur) + length(ps[i + 1]) > {limit} OR cur = '' THEN ps[i + 1] ELSE cur || {glue} || ps[i + 1] END,
      CASE WHEN length(cur) + length(ps[i + 1]) > {limit} AND cur <> '' THEN n + 1 ELSE n END,
      CASE WHEN length(cur) + length(ps[i + 1]) > {limit} AND cur <> '' THEN cur END
    FROM step WHERE i < len(ps)),
  packed AS (SELECT {key}, n - 1 AS chunk_no, done AS chunk FROM step WHERE done IS NOT NULL
    UNION ALL SELECT {key}, n, cur FROM step WHERE i = len(ps) AND cur <> '')"""


@query("chunk_text", f"""WITH RECURSIVE src AS (SELECT doc_id, replace(text, chr(10), ' ') AS x FROM documents),
  {_sql_pack('doc_id', 'src', 'x', "'. '", 500, "'. '")}
  SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, {B.sql_strip('chunk')} AS chunk FROM packed""")
def chunk_text(spark, sf):
    docs = B.read(spark, sf, "documents")
    return explode_rows(docs, ["doc_id"], text.chunk_sentences(F.col("text")), "chunk", "chunk_no")


@query("chunk_lines", f"""WITH RECURSIVE src AS (SELECT doc_id, text AS x FROM documents WHERE length(text) > 4500),
  {_sql_pack('doc_id', 'src', 'x', 'chr(10)', 4500, 'chr(10)')}
  SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, chunk FROM packed
  UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 4500""")
def chunk_lines(spark, sf):
    docs = B.read(spark, sf, "documents")
    return explode_rows(docs, ["doc_id"], text.chunk_lines(F.col("text")), "chunk", "chunk_no")


def _sql_format(template: str, *args: str) -> str:
    parts = [quote(p).replace("\n", "' || chr(10) || '") for p in template.split("%s")]
    out = parts[0]
    for arg, part in zip(args, parts[1:]):
        out += f" || {arg} || {part}"
    return out


@query("build_prompt", f"""WITH {B.TALK} SELECT {KEY},
  {_sql_format(sections.INTERVIEW_PROMPT, 'raw', 'CAST(session_id % 25 AS VARCHAR)')} AS prompt,
  {_sql_format(sections.REVIEWED_PROMPT, 'raw', "CASE WHEN turn_id % 2 = 0 THEN ' None' ELSE chr(10) || en END", 'CAST(session_id % 25 AS VARCHAR)', B.sql_band('session_id % 25', scores.BAND_NAMES))} AS reviewed_prompt,
  {_sql_format(sections.REVIEWED_RESPONSE, 'mr', 'en', "'N/A'", 'raw')} AS response FROM talk""")
def build_prompt(spark, sf):
    score = F.col("session_id") % 25
    note = F.struct(
        F.col("mr").alias("subjective"), F.col("en").alias("objective"),
        F.lit(None).cast("string").alias("assessment"), F.col("raw").alias("plan"),
    )
    t = B.talk(spark, sf).withColumn("note", note)
    return t.select(
        "session_id", "turn_id", sections.interview_prompt(F.col("raw"), score).alias("prompt"),
        sections.reviewed_prompt(
            F.col("raw"), F.when(F.col("turn_id") % 2 == 0, "").otherwise(F.col("en")), score, scores.band(score)
        ).alias("reviewed_prompt"),
        sections.reviewed_response(F.col("note")).alias("response"),
    )


@query("has_content", f"""WITH {B.TALK}, {B.NOTES} SELECT {KEY},
  trim(e_subjective) <> '' OR trim(e_objective) <> '' OR trim(e_assessment) <> '' OR trim(e_plan) <> '' AS english_filled,
  trim(m_objective) <> '' OR trim(m_plan) <> '' AS partly_filled FROM notes""")
def has_content(spark, sf):
    n = B.notes(spark, sf)
    return n.select(
        "session_id", "turn_id", sections.has_content(F.col("english")).alias("english_filled"),
        (~text.is_blank(F.col("marathi.objective")) | ~text.is_blank(F.col("marathi.plan"))).alias("partly_filled"),
    )


@query("validate_records", """WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END AS name,
    CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 160 - 10 END AS age,
    ['json', 'audio', 'transcript', 'fax'][1 + c_custkey % 4] AS source_type,
    'clip' || c_custkey || ['.WAV', '.mp3', '.txt'][1 + c_custkey % 3] AS file_name FROM customer),
  r AS (SELECT *, CASE WHEN trim(name) = '' THEN 'full_name is required'
     WHEN age < 0 OR age > 130 THEN 'age must be between 0 and 130'
     WHEN source_type NOT IN ('json', 'audio', 'transcript') THEN 'bad source_type'
     WHEN source_type = 'audio' AND lower(regexp_extract(file_name, '(\\.[^./]*)$', 1)) NOT IN ('.wav', '.mp3', '.m4a', '.flac', '.ogg') THEN 'unsupported audio format' END AS reject_reason FROM p)
  SELECT id, coalesce(reject_reason, 'ok') AS outcome, CASE WHEN id % 2 = 0 THEN 'target' ELSE 'from result' END AS soap_target FROM r""")
def validate_records(spark, sf):
    k = F.col("c_custkey")
    p = B.read(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 11 == 0, "  ").otherwise(F.col("c_name")).alias("name"),
        F.when(k % 13 != 0, k % 160 - 10).alias("age"),
        F.get(B.lit_array(["json", "audio", "transcript", "fax"]), (k % 4).cast("int")).alias("source_type"),
        F.concat(F.lit("clip"), k.cast("string"),
                 F.get(B.lit_array([".WAV", ".mp3", ".txt"]), (k % 3).cast("int"))).alias("file_name"),
        F.when(k % 2 == 0, "target").otherwise("").alias("given"),
    )
    reason = F.coalesce(
        scores.patient_reject_reason(F.col("name"), F.col("age")),
        scores.visit_reject_reason(F.col("source_type"), F.col("file_name")),
    )
    good, bad = clinic.quarantine(p, reason)
    out = good.withColumn("outcome", F.lit("ok")).unionByName(bad.withColumnRenamed("reject_reason", "outcome"))
    return out.select("id", "outcome", text.or_else(F.col("given"), F.lit("from result")).alias("soap_target"))


@query("turn_preview", f"""WITH {B.TALK} SELECT {KEY}, CASE WHEN role = 'Doctor' THEN 'Clinician' ELSE 'Patient' END AS who,
  CASE WHEN length(raw) > 100 THEN left(raw, 100) || '...' ELSE raw END AS preview
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS rn FROM talk) WHERE rn <= 10""")
def turn_preview(spark, sf):
    return T.turn_preview(B.talk(spark, sf).withColumn("text_en", F.col("raw")))


@query("dialect_compare", f"WITH {B.TALK} SELECT {KEY}, " + ", ".join(
    f"{sql_replace('mr', r)} AS {d}" for d, r in rules.DIALECT_RULES.items())
    + " FROM talk WHERE role = 'Patient' AND length(mr) > 30")
def dialect_compare(spark, sf):
    return T.dialect_compare(B.talk(spark, sf).withColumn("text", F.col("mr")))


@query("rate_wer", """SELECT event_id, round(value, 6) AS wer, CASE WHEN value < 10 THEN 'excellent' WHEN value <= 20 THEN 'good'
  WHEN value <= 30 THEN 'fair' ELSE 'poor' END AS rating FROM events""")
def rate_wer(spark, sf):
    v = F.col("value")
    return B.read(spark, sf, "events").select("event_id", F.round(v, 6).alias("wer"), scores.rate_wer(v).alias("rating"))


@query("real_time_factor", """SELECT event_id, round(value / greatest(event_id % 50, 1e-6), 6) AS rtf,
  round(value / greatest(event_id % 50, 1), 6) AS rtf_whole FROM events""")
def real_time_factor(spark, sf):
    d = F.col("event_id") % 50
    return B.read(spark, sf, "events").select(
        "event_id", F.round(scores.real_time_factor(F.col("value"), d), 6).alias("rtf"),
        F.round(scores.real_time_factor(F.col("value"), d, 1.0), 6).alias("rtf_whole"),
    )
