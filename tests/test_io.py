import csv
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from parlance.sources import documents as D, sinks as K, transcripts as X
from parlance.streaming import jobs


def write(folder, name, body):
    path = folder / name
    path.write_text(body, encoding="utf-8")
    return str(path)


def test_transcripts_of_both_kinds(spark, tmp_path):
    write(tmp_path, "3_TRANSCRIPT.csv", 'start_time\tstop_time\tspeaker\tvalue\n0.0\t1.5\tEllie\t"hi ""you""\nthere"\n2\tbad\tPat\t ok, fine \n')
    write(tmp_path, "4_TRANSCRIPT.csv", 'speaker,value,start_time,stop_time\nEllie,"hi, you",3.0,1.0\n')
    write(tmp_path, "x_TRANSCRIPT.csv", "start_time\tstop_time\tspeaker\tvalue\n0\t1\tEllie\thi\n")
    got = X.scan_transcripts(spark, str(tmp_path)).orderBy("session_id", "turn_id").collect()
    assert [(r.session_id, r.turn_id, r.role, r.text_en, r.start_time, r.stop_time, r.word_count, r.duration_sec) for r in got] == [
        (3, 0, "Doctor", 'hi "you"\nthere', 0.0, 1.5, 3, 1.5), (3, 1, "Patient", "ok, fine", 0.0, 0.0, 2, 0.0),
        (4, 0, "Doctor", "hi, you", 3.0, 1.0, 2, 0.0),
    ]
    tabbed = X.scan_transcripts(spark, str(tmp_path / "3_TRANSCRIPT.csv"), sep="\t").collect()
    assert sorted((r.turn_id, r.text_en) for r in tabbed) == [(0, 'hi "you"\nthere'), (1, "ok, fine")]
    # With and without a named separator the header decides.
    for sep in (None, ","):
        r = X.scan_transcripts(spark, str(tmp_path / "4_TRANSCRIPT.csv"), sep=sep).first()
        assert (r.role, r.speaker, r.text_en, r.start_time, r.stop_time) == ("Doctor", "Ellie", "hi, you", 3.0, 1.0)


def test_transcripts_with_more_columns(spark, tmp_path):
    write(tmp_path, "5_TRANSCRIPT.csv", 'id,start_time,stop_time,speaker,value\n9,1.0,3.0,Ellie,"hi, you"\n')
    write(tmp_path, "6_TRANSCRIPT.csv", "a\tb\tvalue\tc\tspeaker\tstop_time\tstart_time\n1\t2\tyes, it is\t3\tPat\t4\t2\n")
    write(tmp_path, "7_TRANSCRIPT.csv", "start_time,stop_time,speaker,value\n0,1,Pat,short\n")
    read = lambda df: sorted((r.session_id, r.speaker, r.text_en, r.start_time, r.stop_time) for r in df.collect())
    assert read(X.scan_transcripts(spark, str(tmp_path))) == [
        (5, "Ellie", "hi, you", 1.0, 3.0), (6, "Pat", "yes, it is", 2.0, 4.0), (7, "Pat", "short", 0.0, 1.0)]
    assert read(X.scan_transcripts(spark, str(tmp_path / "6_TRANSCRIPT.csv"), sep="\t")) == [(6, "Pat", "yes, it is", 2.0, 4.0)]
    (tmp_path / "none").mkdir()
    assert read(X.scan_transcripts(spark, str(tmp_path / "none"))) == []


ODD_FILES = {
    # Quoted names; a lone quote in a field; quoted separators and line ends; short and long rows.
    "11_T.csv": '"start_time","stop_time","speaker","value"\n1.0,2.0,Ellie,"hi, there"\n2.0,3.0,Pat,he said "no\n3.0,4.0,Pat,yes\n',
    "12_T.csv": 'value\t"speaker"\tx\tstop_time\tstart_time\ny\nsaid "no" twice\tEllie\t1\t5\t4\textra\n"two\nlines ""q"""\tPat\t\t7.5\t6\n\n\t\t\t\t\n',
    "13_T.csv": 'id,speaker,value,start_time,stop_time,speaker\n1,a,t,0,1,Doctor\n2,b,"",x,1,\n',
    "14_T.csv": ' speaker ,value\nPat,only text\n',
    "15_T.csv": "start_time,stop_time,speaker,value\r\n0,1,Pat,crlf\r\n1,2,Ellie,end",
    "16_T.csv": "start_time,stop_time,speaker,value\n",
    "17_T.csv": "",
    "18_[a]{b}_T.csv": "value,speaker\nodd name,Ellie\n",
    "19_T.csv": "\u00e9," * 200 + "value\nx" + "," * 200 + "beyond\t512 characters\n",
}


def test_transcripts_as_csv_readers_have_them(spark, tmp_path):
    """Every file gives what the standard library's reader gives."""
    want = []
    for name, body in ODD_FILES.items():
        (tmp_path / name).write_bytes(body.encode())
        sep = "\t" if "\t" in body[:512] else ","
        for i, r in enumerate(csv.DictReader(io.StringIO(body, newline=""), delimiter=sep)):
            try:
                at = float(r.get("start_time", 0)), float(r.get("stop_time", 0))
            except (TypeError, ValueError):
                at = 0.0, 0.0
            want.append((int(name.split("_")[0]), i, (r.get("speaker") or "").strip(), (r.get("value") or "").strip(), *at))
    got = X.scan_transcripts(spark, str(tmp_path))
    assert sorted((r.session_id, r.turn_id, r.speaker, r.text_en, r.start_time, r.stop_time) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" in plan and "FileScan text" not in plan and "regexp_extract_all" not in plan


def test_last_label_file_wins(spark, tmp_path):
    a = write(tmp_path, "a.csv", "Participant_ID,PHQ8_Score,PHQ8_Binary,Gender\n1,5.0,0,1\n2,,1,\nbad,1,1,1\n3,x,0,0\n")
    b = write(tmp_path, "b.csv", "Participant_ID,PHQ_Score,PHQ8_Binary,Gender\n1,20,1,0\n")
    got = {r.session_id: r for r in X.scan_labels(spark, [(a, "train"), (b, "test")]).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].phq8_score, got[1].split, got[1].severity) == (20, "test", "severe")
    assert got[2].phq8_score is None and got[2].severity == "unknown" and got[2].gender is None
    assert got[3].phq8_score is None


def turn(i, role="Patient"):
    return {"turn_id": i, "start_time": i, "stop_time": i + 1, "role": role, "text_en": f"t{i}"}


def test_session_layouts(spark, tmp_path):
    base = {"phq8_score": 3, "severity": "minimal", "symptom_profile": {"sleep": 3}}
    cases = {
        "1.json": {"session_id": 1, **base, "styles": {"conversation": [turn(0, "Therapor"), turn(1)]}, "persona": {"age": 30}},
        "2.json": {"session_id": 2, **base, "dialects": {"mumbai": [turn(5)], "konkan": [turn(6)]}, "turns": [turn(7)]},
        "3.json": {"session_id": 3, **base, "styles": {"other": [turn(1)], "formal": [turn(2)]}},
        "4.json": {"session_id": 4, **base, "dialects": {}, "turns": [], "messages": [turn(9)]},
    }
    for name, body in cases.items():
        write(tmp_path, name, json.dumps(body, indent=1))
    rows = D.scan_sessions(spark, str(tmp_path)).orderBy("session_id", "turn_id").collect()
    assert [(r.session_id, r.text_en) for r in rows] == [(1, "t0"), (1, "t1"), (2, "t5"), (3, "t2"), (4, "t9")]
    assert rows[0].role == "Therapor" and rows[0].persona.age == 30 and rows[2].persona is None
    konkan = D.scan_sessions(spark, str(tmp_path), dialect="konkan").filter("session_id = 2").collect()
    assert [r.text_en for r in konkan] == ["t6"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "300.zip", "w") as z:
        z.writestr("300_P/300_TRANSCRIPT.csv", "a\tb")
        z.writestr("300_P/300_AUDIO.wav", "no")
    got = D.scan_zip_members(spark, str(tmp_path)).collect()
    assert [(r.file_name, r.content) for r in got] == [("300_TRANSCRIPT.csv", "a\tb")]


def test_members_of_one_archive_are_dealt_out(spark, tmp_path):
    kinds = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    body = lambda i: f"{i}\u00e9\n" * (i % 7) + "x" * i
    with zipfile.ZipFile(tmp_path / "big one.zip", "w") as z:
        for i in range(1000):
            z.writestr(f"a/b/{i}_TRANSCRIPT.csv", body(i), kinds[i % 4] if i < 40 else kinds[i % 2])
            z.writestr(f"a/b/{i}.wav", "no")
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    listed = D.zip_members(spark, str(tmp_path))
    assert "content" not in listed.columns and listed.count() == 1000
    got = D.scan_zip_members(spark, str(tmp_path))
    rows = got.withColumn("task", F.spark_partition_id()).collect()
    assert {r.file_name: r.content for r in rows} == {f"{i}_TRANSCRIPT.csv": body(i) for i in range(1000)}
    assert len(rows) == 1000 and len({r.task for r in rows}) > 1
    # The directory stays, a member's bytes are damaged.
    whole = bytearray((tmp_path / "big one.zip").read_bytes())
    whole[whole.index("4\u00e9\n4\u00e9\n".encode())] ^= 0xFF
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "1.zip").write_bytes(bytes(whole))
    with pytest.raises(Exception, match="damaged member"):
        D.scan_zip_members(spark, str(tmp_path / "bad")).collect()


def test_members_are_handed_on_together(spark, tmp_path, monkeypatch):
    """Bounded frames of many members, not one frame each; a large member goes alone."""
    body = lambda i: "x" * (5000 if i == 50 else 10)
    for name in ("a", "b"):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for i in range(100):
                z.writestr(f"{name}/{i}_TRANSCRIPT.csv", body(i))
    listed = D.zip_members(spark, str(tmp_path)).toPandas()
    monkeypatch.setattr(D, "HAND_BYTES", 400)
    monkeypatch.setattr(D, "HAND_MEMBERS", 30)
    frames = list(D._contents(iter([listed])))
    assert len(frames) == 2 * 5 and max(map(len, frames)) == 30
    assert all(len(f) == 1 or f["content"].str.len().sum() <= 400 for f in frames)
    got = sorted((a[-5:], n, t) for f in frames for a, n, t in f.itertuples(index=False))
    assert got == sorted((f"{k}.zip", f"{i}_TRANSCRIPT.csv", body(i)) for k in "ab" for i in range(100))


def test_turn_files_and_their_manifest(spark, tmp_path):
    rows = [(s, lang, style, t, float(t), t + 0.5, "Doctor", "d", f"e{t}\t\"q\"", f"two\nlines {s}")
            for s in range(300) for lang in ("marathi",) for style in ("formal", "mixed") for t in range(3)]
    master = spark.createDataFrame(rows, "session_id long, language string, style string, turn_id long, start_time double, "
                                         "stop_time double, role string, role_label string, text_en string, text string")
    out = str(tmp_path / "out")
    K.write_turn_files(master, out, folders=8)
    key = lambda r: (r.session_id, r.style, r.turn_id)
    whole = sorted(K.read_turn_files(spark, out).collect(), key=key)
    assert [tuple(r) for r in whole] == sorted(rows, key=lambda r: (r[0], r[2], r[3]))
    assert len(list((tmp_path / "out" / "turns").glob("folder=*/*.csv"))) == 8
    one = K.read_turn_files(spark, out, [17])
    assert sorted(map(tuple, one.collect())) == sorted(r for r in rows if r[0] == 17)
    names = {r.f for r in one.select(F.col("_metadata.file_path").alias("f")).collect()}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert len(names) == 1 and re.search(r"PartitionFilters: \[[^\]]*folder", plan)
    held = spark.read.parquet(f"{out}/manifest").collect()
    assert len(held) == 600 and all((r.rows, r.first_turn, r.last_turn) == (3, 0, 2) for r in held)
    assert K.read_turn_files(spark, out, []).collect() == []
    K.export_turn_folders(master, str(tmp_path / "tree"), [3, 4])
    assert sorted(p.parent.name for p in (tmp_path / "tree").glob("*/*/*/*.csv")) == ["style=formal", "style=formal", "style=mixed", "style=mixed"]


def test_notes(spark, tmp_path):
    write(tmp_path, "soap_12_a.json", json.dumps({"soap_en": {"subjective": "s", "plan": 4}}))
    write(tmp_path, "soap_13_a.json", json.dumps({"session_id": 99, "soap_english": "**SUBJECTIVE:**\none\n**PLAN:**\ntwo"}))
    write(tmp_path, "plain.json", json.dumps({"subjective": "top"}))
    write(tmp_path, "bad.json", "{")
    got = {r.session_id: r.note.asDict() for r in D.scan_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"12", "99", "plain"}
    assert got["12"] == {"subjective": "s", "objective": "", "assessment": "", "plan": "4"}
    assert got["99"]["subjective"] == "- one" and got["99"]["plan"] == "- two"
    assert got["plain"]["subjective"] == "top"


def test_reviews_and_glossary(spark, tmp_path):
    path = write(tmp_path, "r.json", json.dumps([{"session_id": "1", "needs_correction": True, "issues": [{"section": "plan"}]}, {"session_id": 2}]))
    got = D.scan_reviews(spark, path).orderBy("session_id").collect()
    assert [(r.session_id, r.needs_correction, r.overall_quality, len(r.issues)) for r in got] == [("1", True, "unknown", 1), ("2", False, "unknown", 0)]
    path = write(tmp_path, "g.json", json.dumps({"a": "x", "b": {"formal": "f", "hindi": "h"}, "c": {"marathi": "m"}, "d": {}}, indent=1))
    terms = {r.english: (r.marathi, r.hindi) for r in D.scan_glossary(spark, path).collect()}
    assert terms == {"a": ("x", ""), "b": ("f", "h"), "c": ("m", ""), "d": ("", "")}


def test_clip_list_needs_its_columns(spark, tmp_path):
    good = write(tmp_path, "m.csv", "file_name,transcript,language\na.wav,hi, Marathi \n")
    assert D.scan_clips(spark, good).first().language == "marathi"
    with pytest.raises(ValueError, match="language"):
        D.scan_clips(spark, write(tmp_path, "n.csv", "file_name,transcript\na.wav,hi\n"))


def test_training_lines(spark, tmp_path):
    ex = spark.createDataFrame([("train", "p\n1", "r"), ("val", "p2", "r2")], "split string, prompt string, response string")
    out = str(tmp_path / "t")
    K.write_training_lines(ex, out)
    assert spark.read.json(f"{out}/split=train").collect()[0].asDict() == {"prompt": "p\n1", "response": "r"}


def test_stream_takes_each_key_once_however_late(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    schema = "id long, ts timestamp, v string"

    def run(*rows):
        df = spark.createDataFrame([(i, d, v) for i, d, v in rows], "id long, day string, v string")
        df.select("id", F.to_timestamp("day").alias("ts"), "v").coalesce(1).write.mode("append").parquet(src)
        jobs.ingest(jobs.read_files(spark, src, df.select("id", F.to_timestamp("day").alias("ts"), "v").schema),
                    ["id"], "ts", out, state).awaitTermination()
        return sorted((r.id, r.v) for r in spark.read.schema(schema).parquet(out).collect())

    assert run((1, "2024-01-10", "a"), (2, "2024-01-10", "b"), (2, "2024-01-09", "c")) == [(1, "a"), (2, "c")]
    assert run((3, "2024-01-11", "d")) == [(1, "a"), (2, "c"), (3, "d")]
    # A key never seen, days late, and a finished one again.
    assert run((4, "2024-01-09", "e"), (1, "2024-01-12", "f")) == [(1, "a"), (2, "c"), (3, "d"), (4, "e")]


def put(spark, src, *rows):
    df = spark.createDataFrame(rows, "id long, day string, v string")
    df = df.select("id", F.to_timestamp("day").alias("ts"), "v")
    df.write.mode("append").parquet(src)
    return jobs.read_files(spark, src, df.schema)


def test_ingest_never_reads_its_output(spark, tmp_path):
    """Earlier folders are taken away: old keys are known all the same."""
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for n in range(3):
        rows = put(spark, src, *[(i, f"2024-01-{10 + n}", f"{n}") for i in range(4 * n + 4)])
        jobs.ingest(rows, ["id"], "ts", out, state).awaitTermination()
        got = spark.read.parquet(f"{out}/batch={n}").collect()
        assert sorted((r.id, r.v) for r in got) == [(i, str(n)) for i in range(4 * n, 4 * n + 4)]
        (tmp_path / "out" / f"batch={n}").rename(tmp_path / f"gone-{n}")
    rows = put(spark, src, (1, "2023-01-01", "old"), (50, "2023-01-01", "new"), (50, "2022-01-01", "first"))
    query = jobs.ingest(rows, ["id"], "ts", out, state)
    query.awaitTermination()
    assert [(r.id, r.v) for r in spark.read.parquet(f"{out}/batch=3").collect()] == [(50, "first")]
    kept = [s for p in query.recentProgress for s in p["stateOperators"]]
    assert kept and kept[0]["numRowsTotal"] == 13 and any("rocksdb" in m for m in kept[0]["customMetrics"])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_ingest_after_a_failed_batch(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    jobs.ingest(put(spark, src, (1, "2024-01-01", "a")), ["id"], "ts", out, state).awaitTermination()
    real = jobs._publish

    def cut_off(path):
        def write(batch, batch_id):
            real(path)(batch, batch_id)
            raise RuntimeError("lost after writing")

        return write

    rows = put(spark, src, (1, "2024-01-02", "b"), (2, "2024-01-02", "c"))
    monkeypatch.setattr(jobs, "_publish", cut_off)
    with pytest.raises(Exception, match="lost after writing"):
        jobs.ingest(rows, ["id"], "ts", out, state).awaitTermination()
    monkeypatch.setattr(jobs, "_publish", real)
    put(spark, src, (2, "2024-01-03", "d"), (3, "2024-01-03", "e"))
    jobs.ingest(rows, ["id"], "ts", out, state).awaitTermination()
    got = spark.read.parquet(out).collect()
    assert sorted((r.id, r.v) for r in got) == [(1, "a"), (2, "c"), (3, "e")]


def test_ingest_refuses_a_clock_that_went_back(spark, tmp_path, monkeypatch):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    rows = put(spark, src, (1, "2024-01-01", "a"))
    jobs.ingest(rows, ["id"], "ts", out, state).awaitTermination()
    monkeypatch.setattr(jobs.time, "time", lambda: 1e9)
    with pytest.raises(ValueError, match="clock"):
        jobs.ingest(rows, ["id"], "ts", out, state)


def test_visits_in_snapshots(spark, tmp_path):
    """Many batches leave few files to read, and a cut-off merge neither loses nor doubles."""
    out = str(tmp_path / "out")
    day = "timestamp'2024-01-01' + make_dt_interval(cast(id as int))"
    for n in range(200):
        spark.range(n % 3, n % 3 + 2).selectExpr(f"{day} AS day", "1L AS n").coalesce(1).write.parquet(f"{out}/batches/batch={n}")
        if n % 32 == 31:
            jobs.merge_visits(spark, out)
    counted = lambda: sorted((str(r.day)[:10], r.n) for r in jobs._counted(spark, out)[0].collect())
    want = [("2024-01-01", 67), ("2024-01-02", 134), ("2024-01-03", 133), ("2024-01-04", 66)]
    assert counted() == want
    files = jobs.active_visits(spark, out).inputFiles()
    assert len(files) == 1 + 200 - 192
    # A merge that is cut off: its folder has no mark. A batch still being written has none either.
    jobs.merge_visits(spark, out)
    (tmp_path / "out" / "snapshots" / "upto=199" / "_SUCCESS").unlink()
    spark.range(1).selectExpr(f"{day} AS day", "9L AS n").write.parquet(f"{out}/batches/batch=200")
    (tmp_path / "out" / "batches" / "batch=200" / "_SUCCESS").unlink()
    assert counted() == want
    jobs.merge_visits(spark, out)
    assert counted() == want and len(jobs.active_visits(spark, out).inputFiles()) == 1


def test_visits_merge_while_streaming(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for n in range(5):
        rows = put(spark, src, (n, "2024-01-05", "x"), (n, f"2024-01-0{n + 1}", "x"))
        jobs.daily_visits(rows, "ts", out, state, every=2).awaitTermination()
    got = {str(r.window_start)[:10]: r.visits for r in jobs.active_visits(spark, out).collect()}
    assert got["2024-01-01"] == 10 and got["2024-01-05"] == 6
    assert len(jobs.active_visits(spark, out).inputFiles()) <= 3


def test_progress_over_two_runs(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.range(6).select((F.col("id") % 2).alias("k")).write.parquet(src)
    schema = spark.read.parquet(src).schema
    jobs.progress(jobs.read_files(spark, src, schema), "k", out, state).awaitTermination()
    assert {(r.k, r.done) for r in jobs.newest(spark, out).collect()} == {(0, 3), (1, 3)}
    spark.range(2).select(F.lit(1).cast("long").alias("k")).write.mode("append").parquet(src)
    jobs.progress(jobs.read_files(spark, src, schema), "k", out, state).awaitTermination()
    assert {(r.k, r.done) for r in jobs.newest(spark, out).collect()} == {(0, 3), (1, 5)}
    # A folder without its mark is a batch still being written.
    spark.range(1).write.parquet(f"{out}/batch=9")
    (tmp_path / "out" / "batch=9" / "_SUCCESS").unlink()
    assert {(r.k, r.done) for r in jobs.newest(spark, out).collect()} == {(0, 3), (1, 5)}


def test_visits_may_come_late(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    for days in (["2024-01-20", "2024-01-21"], ["2024-01-02", "2024-01-20"]):
        df = spark.createDataFrame([(d,) for d in days], "d string").select(F.to_timestamp("d").alias("ts"))
        df.write.mode("append").parquet(src)
        jobs.daily_visits(jobs.read_files(spark, src, df.schema), "ts", out, state).awaitTermination()
    got = {str(r.window_start.date()): r.visits for r in jobs.active_visits(spark, out).collect()}
    assert got["2024-01-20"] == 3 and got["2024-01-15"] == 3 and got["2024-01-14"] == 2
    assert got["2024-01-02"] == 1 and got["2023-12-27"] == 1 and len(got) == 7 + 8
