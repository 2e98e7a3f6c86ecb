import random

import pytest
from pyspark.sql import functions as F

from quire.operators import candidates, headings, pages, segments
from quire.sources import files
from quire.streaming import requests

MARKS = "doc_id long, ord int, title string, start int"


def test_worked_example(spark):
    marks = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate([("Ch1", 2), ("S1", 2), ("S2", 5), ("Ch2", 9), ("S3", 9)])], MARKS)
    docs = spark.createDataFrame([(1, 10), (2, 3)], "doc_id long, num_pages int")
    found = segments.segments(marks, docs)
    assert [tuple(r)[1:] for r in found.orderBy("seq").collect()] == [(1, "Ch1", 2, 3), (2, "S1", 2, 5), (3, "S2", 5, 9), (4, "Ch2", 9, 10), (5, "S3", 9, 10)]
    named = segments.segment_files(found, F.lit("in/My Book!.pdf")).orderBy("seq").head()
    assert (named.folder, named.file) == ("My Book", "My Book-1-Ch1.pdf")
    assert segments.segments(marks.limit(0), docs).count() == 0


def test_segment_invariants(spark):
    pick = random.Random(9)
    docs = [(d, pick.randrange(1, 30)) for d in range(300)]
    marks = [(d, i, f"t{i}", pick.randrange(0, n)) for d, n in docs for i in range(pick.randrange(1, 9))]
    found = {}
    for r in segments.segments(spark.createDataFrame(marks, MARKS), spark.createDataFrame(docs, "doc_id long, num_pages int")).collect():
        found.setdefault(r.doc_id, []).append(r)
    for d, n in docs:
        rows = sorted(found[d], key=lambda r: r.seq)
        assert [r.seq for r in rows] == list(range(1, len(rows) + 1))
        assert all(r.start < r.end <= n for r in rows)
        assert set().union(*(range(r.start, r.end) for r in rows)) == set(range(rows[0].start, n))


def test_outline_is_in_depth_first_order(spark):
    rows = [(7, 1, None, 0, "a", 0), (7, 2, 1, 0, "b", 1), (7, 4, 2, 0, "c", 2), (7, 3, 1, 1, "d", 3), (7, 5, None, 1, "e", 4), (7, 6, 1, 2, "lost", None), (8, 1, None, 0, "x", 0)]
    flat = segments.flatten_outline(spark.createDataFrame(rows, "doc_id long, id int, parent int, ord int, title string, start int"))
    assert [r.id for r in flat.filter("doc_id = 7").orderBy("ord").collect()] == [1, 2, 4, 3, 5]
    assert [(r.id, r.ord) for r in flat.filter("doc_id = 8").collect()] == [(1, 1)]


def test_pages(spark):
    wanted = spark.createDataFrame([(1, "5,1-3, 2,9-7"), (2, "7")], "doc_id long, pages string")
    assert [r.page for r in pages.expand(wanted).filter("doc_id = 1").orderBy("ord").collect()] == [5, 1, 2, 3, 2]
    assert sorted(tuple(r) for r in pages.selected(wanted).collect()) == [(1, 1), (1, 2), (1, 3), (1, 5), (2, 7)]
    assert sorted(tuple(r) for r in pages.preview(wanted).collect()) == [(1, 5), (2, 7)]
    sheets = spark.createDataFrame([(n,) for n in (999, 1000, 100, 101)], "page int")
    assert [r.page for r in pages.in_file_order(sheets).collect()] == [100, 1000, 101, 999]


def test_processing_modes(spark):
    rows = spark.createDataFrame([(1, 3, b"c"), (1, 1, b"a"), (1, 2, None), (2, 1, b"x"), (2, 1, b"x")], "doc_id long, page int, payload binary")

    def shout(row, value):
        return value.upper()

    permissive = pages.process(rows, [("shout", shout)])
    assert {(r.doc_id, r.page): r.error is None for r in permissive.collect()} == {(1, 3): True, (1, 1): True, (1, 2): False, (2, 1): True}
    assert pages.errors(permissive).count() == 1
    assert {r.doc_id: [bytes(p) for p in r.payloads] for r in pages.merged(permissive, "payload", error="error").collect()} == {1: [b"A", b"C"], 2: [b"X"]}
    assert [r.doc_id for r in pages.merged(permissive, "payload", mode="dropmalformed", error="error").collect()] == [2]
    assert pages.process(rows, [("shout", shout)], mode="dropmalformed").count() == 4
    with pytest.raises(Exception):
        pages.process(rows, [("shout", shout)], mode="failfast").collect()
    with pytest.raises(Exception):
        pages.merged(permissive, "payload", mode="failfast", error="error").collect()
    with pytest.raises(ValueError):
        pages.merged(permissive, "payload", mode="other")


def test_headings(spark):
    rows = [(1, 0, "section"), (1, 1, "subsection"), (1, 2, "subsection"), (1, 3, "section"), (1, 4, "subsection"), (2, 0, "subsection")]
    frame = spark.createDataFrame(rows, "doc_id int, pos int, level string")
    on = [(r.section, r.subsection) for r in headings.counters(frame).orderBy("doc_id", "pos").collect()]
    anew = [(r.section, r.subsection) for r in headings.counters(frame, continuous=False).orderBy("doc_id", "pos").collect()]
    assert on == [(1, 0), (1, 1), (1, 2), (2, 2), (2, 3), (0, 1)] and anew == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (0, 1)]
    layouts = headings.layout_rows(spark)
    shown = spark.createDataFrame([(k, lv, "T", 2, 5) for k in ("newdisplay", "newevans", "newevanshempel", "newhempel") for lv in ("section", "subsection")], "layout string, level string, title string, section int, subsection int")
    got = {(r.layout, r.level): (r.number, r.shown, r.font) for r in headings.numbered(shown, layouts).collect()}
    assert got["newdisplay", "section"] == ("2.", "T", "scshape") and got["newevans", "section"] == ("II", "T", "bfseries")
    assert got["newevanshempel", "subsection"] == ("5.", "T.---", "bfseries") and got["newhempel", "section"] == ("2.", "T.---", "bfseries")


def test_candidates(spark):
    names = spark.createDataFrame([(f"c{i:02d}",) for i in range(30)], "candidate string")
    assert candidates.union(names, names).count() == 30
    assert candidates.shown(names, "candidate").count() == 10
    assert candidates.picked(names, F.lit(0), "candidate").head().candidate == "c09"
    assert candidates.picked(names.limit(3), F.lit(5), "candidate").count() == 1
    assert candidates.filtered(names, F.lit("1 c0")).head().candidate == "c01"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "parts.txt").write_text("Intro;1;4\n;comment;1;2\nTwo;;5;;6\n")
    parts = files.parts_list(spark, str(tmp_path / "parts.txt"))
    assert [(r.title, r.start, r.end) for r in parts.orderBy("ord").collect()] == [("Intro", 1, 4), ("Two", 5, 6)]
    numbered = segments.numbered_parts(parts)
    assert [r.page for r in segments.part_pages(numbered).orderBy("seq", "page").collect()] == [1, 2, 3, 4, 5, 6]
    files.write_parts(numbered.withColumn("folder", F.lit("book")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("seq = 2").head().title == "Two"
    for name in ("page_002.pdf", "page_001.pdf", "other.pdf"):
        (tmp_path / "book").mkdir(exist_ok=True)
        (tmp_path / "book" / name).write_bytes(name.encode())
    sheets = files.page_files(spark, str(tmp_path / "book"))
    assert [r.name for r in sheets.collect()] == ["page_001.pdf", "page_002.pdf"]
    files.write_manifest(sheets, str(tmp_path / "list"))
    assert [r.value[-14:] for r in spark.read.text(str(tmp_path / "list")).collect()] == ['/page_001.pdf"', '/page_002.pdf"']
    outline = files.opened(sheets, lambda b: (3, [(1, None, 0, b.decode(), 0)])).orderBy("path").head()
    assert outline.num_pages == 3 and outline.outline[0].title == "page_001.pdf"
    merged = spark.createDataFrame([("d/x.pdf", [b"1"])], "path string, payloads array<binary>")
    files.write_merged(merged, str(tmp_path / "merged"), "me")
    row = spark.read.parquet(str(tmp_path / "merged")).head()
    assert row.output == "d/x_cleaned.pdf" and row.info["Title"] == "x_Cleaned"
    with pytest.raises(Exception):
        files.documents(spark, str(tmp_path / "absent")).collect()


def test_streaming_expansion(spark, tmp_path):
    spark.createDataFrame([("a", "3,1-2,3")], "path string, pages string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, pages string").json(str(tmp_path / "in"))
    run = requests.expanded(stream).writeStream.format("memory").queryName("expanded").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    run.awaitTermination(60)
    assert sorted(r.file for r in spark.sql("SELECT file FROM expanded").collect()) == ["page_001", "page_002", "page_003"]
