"""JSON and archive inputs: sessions, notes, reviews, glossaries, zips, clip lists."""

from __future__ import annotations

import os
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.functions import sections
from parlance.functions.rows import explode_rows
from parlance.functions.text import strip

TURN = (
    "struct<turn_id:long,start_time:double,stop_time:double,role:string,speaker:string,"
    "text_en:string,text:string>"
)
SESSION = f"""session_id long, phq8_score int, phq8_binary int, severity string, gender string,
    split string, language string,
    symptom_profile struct<sleep:int,energy:int,interest:int,depressed:int,appetite:int,
        guilt:int,concentration:int,psychomotor:int>,
    persona struct<age:int,gender:string,occupation:string,city:string>,
    dialects map<string,array<{TURN}>>, styles map<string,array<{TURN}>>,
    turns array<{TURN}>, conversation array<{TURN}>, dialogue array<{TURN}>,
    messages array<{TURN}>"""
REVIEW = """session_id string, overall_quality string, needs_correction boolean,
    issues array<struct<section:string,issue_type:string,original:string,correction:string,
        explanation:string>>,
    corrected_soap_marathi struct<subjective:string,objective:string,assessment:string,plan:string>,
    reviewer_notes string"""

# Style order, archive members kept, clip columns, note keys per language.
STYLE_ORDER = ["formal_translated", "translated", "formal", "colloquial", "neutral"]
KEEP_SUFFIXES = ("_TRANSCRIPT.csv",)
CLIP_COLUMNS = ["file_name", "transcript", "language"]
NOTE_KEYS = {
    "english": ["soap_english", "soap_en"],
    "marathi": ["soap_marathi", "soap_mr"],
    "hindi": ["soap_hindi", "soap_hi"],
}


def _filled(a: Column) -> Column:
    return F.when(F.size(a) > 0, a)


def turns_of_session(dialect: str | None = None) -> Column:
    """The first non-empty turn list of a session record."""
    options = []
    if dialect:
        options.append(_filled(F.col("dialects")[dialect]))
    options.append(_filled(F.get(F.map_values("dialects"), F.lit(0))))
    options += [_filled(F.col("styles")[s]) for s in STYLE_ORDER]
    options.append(F.get(F.filter(F.map_values("styles"), lambda a: F.size(a) > 0), F.lit(0)))
    options += [_filled(F.col(c)) for c in ("turns", "conversation", "dialogue", "messages")]
    return F.coalesce(*options)


def scan_sessions(
    spark: SparkSession, path: str, dialect: str | None = None, multi_line: bool = True
) -> DataFrame:
    """Turns of session records, in list order; unknown roles are kept as written."""
    raw = spark.read.schema(SESSION).option("multiLine", multi_line).json(path)
    return (
        explode_rows(
            raw, ["session_id", "phq8_score", "severity", "symptom_profile", "persona"],
            turns_of_session(dialect), "t", "pos",
        )
        .select(
            "session_id", F.coalesce("t.turn_id", F.col("pos").cast("long")).alias("turn_id"),
            "phq8_score", "severity", "symptom_profile", "persona",
            "t.start_time", "t.stop_time",
            F.coalesce("t.role", "t.speaker", F.lit("Unknown")).alias("role"),
            F.coalesce("t.text_en", F.lit("")).alias("text_en"),
            F.coalesce("t.text", F.lit("")).alias("text"),
        )
    )


# Bytes of archives a task is to read, and bytes and number of members handed on at once.
READ_BYTES = 64 << 20
HAND_BYTES, HAND_MEMBERS = 4 << 20, 1000
MEMBER = (
    "archive string, member string, method int, offset bigint, packed bigint, size bigint, crc bigint"
)


def file_system(path: str):
    """File system of a path, as Spark names it, and the path inside it."""
    from pyarrow import fs

    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@"))


def zip_members(
    spark: SparkSession, path: str, suffixes: tuple[str, ...] = KEEP_SUFFIXES
) -> DataFrame:
    """The wanted members of all archives under ``path`` and where they lie, one row each.

    An archive's directory is at its end, so no more than that is read here.
    """

    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive in pdf["path"]:
                system, inside = file_system(archive)
                with system.open_input_file(inside) as f:
                    # A member takes 98 bytes at least; what is shorter has none.
                    listed = zipfile.ZipFile(f).infolist() if f.size() >= 98 else []
                rows = [
                    (archive, m.filename, m.compress_type, m.header_offset, m.compress_size, m.file_size, m.CRC)
                    for m in listed if m.filename.endswith(suffixes)
                ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER.split(", ")])

    return _archives(spark, path).select("path").mapInPandas(list_members, MEMBER)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """Archives by path and length; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "length")


def _inflate(f, member) -> bytes:
    """A member's bytes, from its own stretch of the archive."""
    if member.method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        f.seek(0)
        with zipfile.ZipFile(f) as z:
            return z.read(member.member)
    f.seek(member.offset)
    # A local header has 30 bytes, the lengths of name and extra field at its end.
    name, extra = struct.unpack("<HH", f.read(30)[26:])
    f.seek(member.offset + 30 + name + extra)
    body = f.read(member.packed)
    data = body if member.method == zipfile.ZIP_STORED else zlib.decompress(body, -15)
    if len(data) != member.size or zlib.crc32(data) != member.crc:
        raise ValueError(f"damaged member {member.member} in {member.archive}")
    return data


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts of listed members: small ones are handed on together, large ones alone."""
    for pdf in batches:
        for archive, members in pdf.groupby("archive", sort=False):
            system, inside = file_system(archive)
            names, texts, held = [], [], 0
            with system.open_input_file(inside) as f:
                for m in members.sort_values("offset").itertuples(index=False):
                    if names and (held + m.size > HAND_BYTES or len(names) == HAND_MEMBERS):
                        yield pd.DataFrame({"archive": archive, "file_name": names, "content": texts})
                        names, texts, held = [], [], 0
                    names.append(m.member.rsplit("/", 1)[-1])
                    texts.append(_inflate(f, m).decode("utf-8"))
                    held += m.size
            yield pd.DataFrame({"archive": archive, "file_name": names, "content": texts})


def scan_zip_members(
    spark: SparkSession, path: str, suffixes: tuple[str, ...] = KEEP_SUFFIXES
) -> DataFrame:
    """Text of the archive members with a wanted suffix, their folders dropped.

    The archives' directories are read first. Their members are then dealt out one by one,
    so those of one large archive are read in many tasks, each its own bytes alone, and no
    row holds more than a member. Small members are handed on together, large ones alone.
    ``path`` may lie in any file system Arrow can open. A damaged member ends the job.
    """

    # What is dealt are short rows that stand for long reads, so their number is no guide.
    size = _archives(spark, path).agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    dealt = zip_members(spark, path, suffixes).repartition(tasks, "archive", "offset")
    return dealt.mapInPandas(_contents, "archive string, file_name string, content string")


def scan_clips(spark: SparkSession, path: str) -> DataFrame:
    """Clip list with its required columns checked."""
    clips = (
        spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    missing = [c for c in CLIP_COLUMNS if c not in clips.columns]
    if missing:
        raise ValueError(f"missing columns in clip list: {missing}")
    return clips.withColumn("language", F.lower(strip(F.col("language"))))


def scan_glossary(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Terms of a JSON map from term to text or to {formal, marathi, hindi}, per file or line."""
    raw = spark.read.text(path, wholetext=whole_file)
    terms = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("english", "v"))
    forms = F.from_json("v", "struct<formal:string,marathi:string,hindi:string>")
    nested = F.startswith(F.ltrim("v"), F.lit("{"))
    return terms.select(
        "english",
        F.when(nested, F.coalesce(forms["formal"], forms["marathi"], F.lit("")))
        .otherwise(F.col("v")).alias("marathi"),
        F.when(nested, F.coalesce(forms["hindi"], F.lit(""))).otherwise("").alias("hindi"),
        F.lit("clinical").alias("category"),
    )


def parse_review(reply: Column) -> Column:
    """A model's review, fenced or bare, as a struct; NULL when it is not JSON."""
    body = F.try_parse_json(sections.strip_fence(reply))
    return F.when(body.isNotNull(), F.from_json(F.to_json(body), REVIEW))


def scan_reviews(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Reviews of JSON arrays, or of one object per line, with their defaults filled in."""
    return (
        spark.read.schema(REVIEW).option("multiLine", multi_line).json(path)
        .withColumn("overall_quality", F.coalesce("overall_quality", F.lit("unknown")))
        .withColumn("needs_correction", F.coalesce("needs_correction", F.lit(False)))
        .withColumn("issues", F.coalesce("issues", F.array().cast("array<struct<section:string,"
                    "issue_type:string,original:string,correction:string,explanation:string>>")))
    )


def note_sections(payload: Column, language: str = "english") -> Column:
    """Section struct of a note VARIANT: nested object, text to be split, or top level."""
    keys = NOTE_KEYS.get(language, [f"soap_{language}"])

    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(payload, f"$.{key}", "variant"))

    def nested(prefix: str) -> Column:
        return F.struct(
            *[
                F.coalesce(F.try_variant_get(payload, f"$.{prefix}{s}", "string"), F.lit("")).alias(s)
                for s in sections.SECTIONS
            ]
        )

    out = None
    for key in keys:
        is_object = F.startswith(kind(key), F.lit("OBJECT"))
        out = F.when(is_object, nested(f"{key}.")) if out is None else out.when(is_object, nested(f"{key}."))
    as_text = F.coalesce(
        *[F.when(kind(k) == "STRING", F.try_variant_get(payload, f"$.{k}", "string")) for k in keys]
    )
    out = out.when(as_text.isNotNull(), sections.split_sections_robust(as_text))
    return out.otherwise(nested(""))


def scan_notes(spark: SparkSession, path: str, language: str = "english") -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("file_name"), "value"
    )
    return parse_notes(files, language)


def parse_notes(files: DataFrame, language: str = "english") -> DataFrame:
    """Notes out of (file_name, value) JSON texts; broken texts are skipped."""
    raw = files.select("file_name", F.try_parse_json("value").alias("p"))
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    digits = F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit(""))
    return raw.filter(F.col("p").isNotNull()).select(
        F.coalesce(F.try_variant_get("p", "$.session_id", "string"), digits, stem).alias("session_id"),
        "file_name", note_sections(F.col("p"), language).alias("note"),
    )
