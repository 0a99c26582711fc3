from __future__ import annotations

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tracebook.sources import documents as D
from tracebook.sources.calendars import slots_from_csv, slots_from_file, slots_from_ics, slots_from_json
from tracebook.sources.documents import html_text, read_pages
from tracebook.sources.pdf import pages_of
from tracebook.sources.jsonl import read_jsonl, read_jsonl_strict, read_tsv, write_tsv
from tracebook.sources.store import SnapshotStore
from tracebook.sources.tables import shared_dir, stage, sweep

SCHEMA = StructType().add("a", StringType()).add("b", StringType())


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes(b'\xef\xbb\xbf{"a":"1"}\n\nnot json\n{"a":"2\xe2\x80\xa8x","b":"y"}\n')
    assert sorted(r["a"] for r in read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA).collect()) == ["1", "2 x"]
    good, bad = read_jsonl_strict(spark, str(tmp_path / "x.jsonl"), SCHEMA)
    assert good.count() == 2 and [(r["line_no"], r["line"]) for r in bad.collect()] == [(3, "not json")]
    assert read_jsonl(spark, str(tmp_path / "none.jsonl"), SCHEMA).count() == 0


def test_tsv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("x\t1", "ok"), ('q"q', ""), ("z", None)], SCHEMA)
    write_tsv(df, str(tmp_path / "t"))
    assert [r["a"] for r in read_tsv(spark, str(tmp_path / "t"), SCHEMA, "b").collect()] == ["x\t1"]


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w = 'xmlns:w="urn:w"'
    (tmp_path / "c").mkdir()
    (tmp_path / "c/a.docx").write_bytes(zipped({"word/document.xml": f"<w:document {w}><w:body><w:p><w:t>one</w:t></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:t>cell</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"}))
    (tmp_path / "c/b.epub").write_bytes(zipped({"META-INF/container.xml": '<c><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></c>', "o/p.opf": '<p><manifest><item id="i" href="x.xhtml"/></manifest><spine><itemref idref="i"/></spine></p>', "o/x.xhtml": "<html><head><title>t</title></head><body><h1>Top</h1><table><tr><td>v</td></tr></table></body></html>"}))
    slide = '<p xmlns:a="urn:a"><sp><a:off x="5" y="9"/><a:p><a:t>low</a:t></a:p></sp><sp><a:off x="5" y="1"/><a:p><a:t>high</a:t></a:p></sp><graphicFrame><a:off x="0" y="20"/><a:tr><a:tc><a:p><a:t>p</a:t></a:p></a:tc><a:tc><a:p><a:t>q</a:t></a:p></a:tc></a:tr></graphicFrame></p>'
    (tmp_path / "c/s.pptx").write_bytes(zipped({"ppt/slides/slide1.xml": slide, "ppt/slides/slide10.xml": slide, "ppt/slides/slide2.xml": slide}))
    (tmp_path / "c/bad.docx").write_bytes(b"no zip")
    pages = read_pages(spark, str(tmp_path / "c"))
    got = {(r["source_file"], r["page_no"]): r for r in pages.collect()}
    assert got[("a.docx", 2)]["text"] == "cell" and got[("b.epub", 1)]["section_title"] == "Top" and got[("b.epub", 1)]["has_table"]
    assert got[("s.pptx", 1)]["text"] == "high\nlow\np | q" and got[("s.pptx", 3)]["page_label"] == "Slide 3"
    assert got[("bad.docx", None)]["warning"].startswith("BadZipFile")
    assert {r["source_file"] for r in read_pages(spark, str(tmp_path / "c"), known=pages.filter("page_no is not null")).collect()} == {"bad.docx"}


def test_html():
    assert html_text("<head><title>x</title></head><p>a &amp; b</p><script>var s='</p>';</script><div>c<br>d</div>") == "a & b\n\nc\nd"


def test_calendars():
    csv = "﻿课程,星期,开始,结束,周次\nC1,1,08:00,09:00,1-8单\n"
    assert slots_from_csv(csv) == [{"course_id": "C1", "weekday": 1, "start": "08:00", "end": "09:00", "weeks": "1-8单"}]
    ics = "BEGIN:VEVENT\nSUMMARY:C1\nDTSTART:20260302T080000\nDTEND:20260302T090000\nRRULE:FREQ=WEEKLY;COUNT=4\nEXDATE:20260309T080000\nEND:VEVENT"
    assert slots_from_ics(ics, dt.date(2026, 3, 2), 17) == [{"course_id": "C1", "weekday": 1, "start": "08:00", "end": "09:00", "weeks": "1,3,4"}]
    with pytest.raises(ValueError):
        slots_from_ics(ics.replace("WEEKLY", "MONTHLY"), dt.date(2026, 3, 2), 17)


def ics_of(*lines):
    return "\r\n".join(["BEGIN:VCALENDAR", "BEGIN:VEVENT", "SUMMARY:C1", *lines, "END:VEVENT", "END:VCALENDAR"])


MONDAY = dt.date(2026, 3, 2)
EIGHT = ("DTSTART:20260302T080000", "DTEND:20260302T090000")


def test_calendar_zones_and_alarms():
    utc = ics_of("DTSTART:20260302T000000Z", "DTEND:20260302T010000Z", "BEGIN:VALARM", "DURATION:PT5M", "END:VALARM")
    assert slots_from_ics(utc, MONDAY, 17, "Asia/Shanghai") == [{"course_id": "C1", "weekday": 1, "start": "08:00", "end": "09:00", "weeks": "1"}]
    there = ics_of("DTSTART;TZID=America/New_York:20260302T200000", "DTEND;TZID=America/New_York:20260302T210000", "RRULE:FREQ=WEEKLY;INTERVAL=2;UNTIL=20260415", "EXDATE;TZID=America/New_York:20260316T200000")
    # the clocks of New York change on 8 March
    assert [(x["weekday"], x["start"], x["weeks"]) for x in slots_from_ics(there, MONDAY, 17, "Asia/Shanghai")] == [(2, "08:00", "5,7"), (2, "09:00", "1")]
    days = ics_of(*EIGHT, "RRULE:FREQ=WEEKLY;BYDAY=MO,WE;\r\n COUNT=3", "STATUS:CONFIRMED")
    assert [(x["weekday"], x["weeks"]) for x in slots_from_ics(days, MONDAY, 17)] == [(1, "1,2"), (3, "1")]
    assert slots_from_ics(ics_of(*EIGHT, "STATUS:CANCELLED"), MONDAY, 17) == []
    assert slots_from_ics(ics_of(*EIGHT, "RRULE:FREQ=WEEKLY"), MONDAY, 3, resolve=lambda c: c + "!") == [{"course_id": "C1!", "weekday": 1, "start": "08:00", "end": "09:00", "weeks": "1,2,3"}]


@pytest.mark.parametrize("lines", [
    (*EIGHT, "RRULE:FREQ=WEEKLY;BYMONTH=4"), (*EIGHT, "RRULE:FREQ=MONTHLY"), (*EIGHT, "RDATE:20260303T080000"), (*EIGHT, "RECURRENCE-ID:20260302T080000"), ("DTSTART:20260302T080000", "DURATION:PT1H"), ("DTSTART;VALUE=DATE:20260302", "DTEND;VALUE=DATE:20260303"),
    ("DTSTART:20260302T080000", "DTEND:20260303T090000"), ("DTSTART:20260302T080000", "DTEND:20260302T080000"), ("DTSTART;TZID=No/Where:20260302T080000", "DTEND:20260302T090000"), (*EIGHT, "RRULE:FREQ=WEEKLY;BYDAY=1MO"), (*EIGHT, "BEGIN:VALARM"),
])
def test_calendars_refuse(lines):
    with pytest.raises(ValueError):
        slots_from_ics(ics_of(*lines), MONDAY, 17)


def test_timetables_with_chinese_weekdays_and_json():
    rows = [{"course_id": "C1", "weekday": d, "start": "08:00", "end": "09:00", "weeks": ""} for d in (2, 2, 7, 1)]
    assert slots_from_csv("课程,星期,开始,结束\nC1,二,08:00,09:00\nC1,星期二,08:00,09:00\nC1,周日,08:00,09:00\nC1,Monday,08:00,09:00\n") == rows
    assert slots_from_json('{"slots": [{"course_id": "c", "weekday": 2, "start": "8:00", "end": "9:00", "weeks": null, "x": 1}]}', str.upper) == [{"course_id": "C", "weekday": 2, "start": "8:00", "end": "9:00", "weeks": ""}]
    assert slots_from_file("t.CSV", "course_id,weekday,start,end\n", MONDAY, 3) == [] and slots_from_file("t.json", "[]", MONDAY, 3) == []
    for bad in (lambda: slots_from_csv("课程,星期,开始,结束\nC1,8,1,2\n"), lambda: slots_from_csv("课程,星期\nC1,1\n"), lambda: slots_from_json("3"), lambda: slots_from_file("t.xls", "", MONDAY, 3)):
        with pytest.raises(ValueError):
            bad()


def test_slides_in_the_order_of_the_deck_with_their_own_notes():
    text = lambda t: f'<p xmlns:a="urn:a"><sp><a:p><a:t>{t}</a:t></a:p></sp></p>'
    rel = lambda i, kind, target: f'<Relationships><Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"/></Relationships>'
    deck = '<p xmlns:r="urn:r"><sldIdLst><sldId id="256" r:id="r2"/><sldId id="257" r:id="r1"/></sldIdLst></p>'
    rels = '<Relationships><Relationship Id="r1" Type="http://x/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="http://x/slide" Target="/ppt/slides/slide2.xml"/></Relationships>'
    files = {"ppt/presentation.xml": deck, "ppt/_rels/presentation.xml.rels": rels, "ppt/slides/slide1.xml": text("one"), "ppt/slides/slide2.xml": text("two"), "ppt/notesSlides/notesSlide1.xml": text("said"), "ppt/slides/_rels/slide1.xml.rels": rel("n", "notesSlide", "../notesSlides/notesSlide1.xml")}
    assert [p[1] for p in D.read_pptx(zipped(files))] == ["two", "one\n[备注] said"]


def pdf_of(contents, extra=b"", trailer=b"", packed=False):
    import zlib

    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [ " + kids + b" ] /Resources << /Font << /F1 3 0 R >> >> >>", 3: b"<< /Type /Font " + extra + b" >>"}
    for i, c in enumerate(contents):
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        body = zlib.compress(c) if packed else c
        objects[11 + 2 * i] = b"<< /Length %d %s >>\nstream\n" % (len(body), b"/Filter /FlateDecode" if packed else b"") + body + b"\nendstream"
    cmap = b"1 beginbfrange <0001> <0002> <706B> endbfrange 1 beginbfchar <0003> <0041> endbfchar"
    objects[4] = b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream"
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (k, v) for k, v in objects.items()) + b"\ntrailer << /Root 1 0 R " + trailer + b" >>"


def test_pdf(spark, tmp_path):
    first = b"BT /F1 12 Tf 72 700 Td (Hello \\(world\\)) Tj 0 -14 Td [(sp)-300(ace) 20 (d)] TJ T* (next) ' ET"
    for packed in (False, True):
        assert [t for t, _ in pages_of(pdf_of([first, b"", b"BT (\\101B) Tj ET"], packed=packed))] == ["Hello (world)\nsp aced\nnext", "", "AB"]
    assert next(pages_of(pdf_of([b"BT /F1 9 Tf <000100020003> Tj ET"], extra=b"/ToUnicode 4 0 R")))[0] == "火灬A"
    text, warning = next(pages_of(pdf_of([b"x"]).replace(b"/Length 1 ", b"/Length 1 /Filter /LZWDecode ")))
    assert text == "" and "LZWDecode" in warning
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.pdf").write_bytes(pdf_of([first]))
    (tmp_path / "p/locked.pdf").write_bytes(pdf_of([first], trailer=b"/Encrypt 9 0 R"))
    (tmp_path / "p/bad.pdf").write_bytes(b"nothing")
    got = {(r["source_file"], r["page_no"]): r for r in read_pages(spark, str(tmp_path / "p")).collect()}
    assert got["a.pdf", 1]["text"].startswith("Hello (world)") and "encrypted" in got["locked.pdf", None]["warning"] and got["bad.pdf", None]["warning"]
    with pytest.raises(ValueError, match="own"):
        D.choose({"pdf": "other"})
    D.choose({"pdf": "own"})


def test_files_collected_known_and_replaced(spark):
    listing = spark.createDataFrame([("a/x.pdf",), ("a/x.pdf",), ("a/y.docx",), ("a/z.exe",), ("a/~$y.docx",)], "path string")
    assert {r["path"] for r in D.collect_files(listing, spark.createDataFrame([("a/y.docx",)], "drop string")).collect()} == {"a/x.pdf"}
    current = spark.createDataFrame([("f1", "a", 1, "s", "old"), ("f1", "a", 2, "s", "old"), ("f2", "b", 1, "s", "kept"), ("f3", "c", 1, "s", "kept")], "file_id string, source_file string, page_no int, source_sha1 string, text string").withColumn("course", F.lit("k"))
    read = spark.createDataFrame([("a", 1, "new", None), ("c", None, None, "broken"), ("d", 1, "new", "odd")], "source_file string, page_no int, text string, warning string")
    pages, report = D.replaced_files(current, read)
    assert sorted((r["source_file"], r["page_no"], r["text"]) for r in pages.collect()) == [("a", 1, "new"), ("b", 1, "kept"), ("c", 1, "kept"), ("d", 1, "new")]
    assert {r["source_file"]: (r["outcome"], r["pages"], r["warnings"]) for r in report.collect()} == {"a": ("changed", 1, 0), "c": ("failed", 0, 1), "d": ("new", 1, 1)}
    assert {r["file_id"]: r["pages"] for r in D.known_files(current).collect()} == {"f1": 2, "f2": 1, "f3": 1}


def test_store(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    one = store.commit({"a": spark.range(3), "b": spark.range(1)})
    two = store.commit({"a": spark.range(5)}, expected=one)
    assert store.table("a").count() == 5 and store.table("b").count() == 1
    with pytest.raises(ValueError):
        store.commit({"a": spark.range(1)}, expected=one)
    store.restore(one)
    assert store.table("a").count() == 3 and [h["id"] for h in store.history()][:2] == [one, two]


def test_staging_follows_the_session(spark):
    df = stage(spark.range(4), "t")
    assert df.count() == 4 and shared_dir(spark).removeprefix("file:") in df.inputFiles()[0]
    assert sorted(stage(spark.createDataFrame([(1, "x"), (2, "y")], "n int, k string"), "by", by="k").filter("k = 'y'").collect()) == [(2, "y")]
    sweep(spark)


def test_an_unset_folder_is_refused_on_a_cluster():
    from types import SimpleNamespace

    context = SimpleNamespace(applicationId="other", master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: d)))


def test_a_job_that_died_in_restore_leaves_the_store_readable(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    one = store.commit({"a": spark.range(3)})
    (tmp_path / "s/.half.json").write_text('{"id":')
    two = store.commit({"a": spark.range(4)})
    assert store.restore(one) != two and store.table("a").count() == 3
    with pytest.raises(KeyError):
        store.restore("none")


def test_a_damaged_snapshot_is_not_restored(spark, tmp_path):
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    one = store.commit({"a": spark.range(3), "b": spark.createDataFrame([(1, None), (1, None)], "x int, y string")})
    two = store.commit({"a": spark.range(4)})
    assert store.damaged(one) == store.damaged(two) == []
    spark.createDataFrame([(2, "z")], "x int, y string").write.mode("overwrite").parquet(store.current()["tables"]["b"])
    assert store.damaged(two) == ["b"]
    with pytest.raises(ValueError, match="damaged: b"):
        store.restore(one)
