"""Files, ingest, streams, state changes."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from foliary.operators import filters as flt
from foliary.operators import pages as pg
from foliary.operators import upkeep as u
from foliary.plans.upkeep_queries import _word_file
from foliary.sources import files as fl
from foliary.sources import tables as tb
from foliary.streaming import jobs


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.pdf").write_bytes(b"%PDF-1.4 one")
    (src / "b.PDF").write_bytes(b"%PDF-1.4 two")
    (src / "copy.pdf").write_bytes(b"%PDF-1.4 one")
    (src / "n.txt").write_bytes("café \n".encode() + b"\xff ok")
    (src / "w.docx").write_bytes(_word_file(["Client <A>", "Second"]))
    (src / "bad.docx").write_bytes(b"PK\x03\x04 broken")
    (src / "evil.txt").write_bytes(b"#!/bin/sh\nrm")
    (src / "fake.pdf").write_bytes(b"plain words")
    return src


def test_word_and_plain_text(spark, folder):
    rows = {
        r.path.rsplit("/", 1)[1]: r.extracted_text
        for r in fl.extract_texts(fl.read_files(spark, str(folder))).collect()
    }
    assert rows["w.docx"] == "Client <A>\nSecond\nChars | 10\nChars | 6"
    assert rows["bad.docx"] == ""
    assert rows["n.txt"] == "café \n ok"
    assert rows["a.pdf"] == ""
    bad = fl.unreadable(fl.extract_texts(fl.read_files(spark, str(folder)))).collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.docx"]


def test_not_a_word_file():
    assert fl.word_text(b"") == ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.xml", "<x/>")
    assert fl.word_text(out.getvalue()) == ""


def test_validation(spark, folder):
    rows = {r.filename: r for r in fl.validation_report(fl.read_files(spark, str(folder))).collect()}
    assert rows["a.pdf"].valid and rows["w.docx"].valid
    assert rows["evil.txt"].errors == ["potentially malicious content"]
    assert rows["fake.pdf"].errors == ["content does not match extension"]


def test_ingest_is_incremental_and_rescans_without_duplicates(spark, folder, tmp_path):
    table, checkpoint = str(tmp_path / "catalog"), str(tmp_path / "cp")
    first = jobs.ingest_folder(spark, str(folder), table, checkpoint)
    assert sorted(r.filename for r in first.collect()) == ["a.pdf", "b.PDF", "fake.pdf"]
    (folder / "c.pdf").write_bytes(b"%PDF-1.4 three")
    (folder / "d.pdf").write_bytes(b"%PDF-1.4 two")
    second = jobs.ingest_folder(spark, str(folder), table, checkpoint)
    assert sorted(r.filename for r in second.collect()) == ["a.pdf", "b.PDF", "c.pdf", "fake.pdf"]
    again = jobs.ingest_folder(spark, str(folder), table, str(tmp_path / "cp2"))
    assert again.count() == 4


def test_taxonomy_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text(
        'primary_category,subcategory,term\n"Policy, A","Tax","Taxes"\n" Policy, A ", Tax ,Taxes\n'
        '"Policy, A","","Roads"\n,x,y\nZ,,\n'
    )
    raw = tb.read_csv(spark, str(path))
    old = spark.createDataFrame([("Policy, A", None, "Roads")], "primary_category string, subcategory string, term string")
    new = tb.new_taxonomy_terms(raw, old)
    assert [tuple(r) for r in new.collect()] == [("Policy, A", "Tax", "Taxes")]
    assert tuple(tb.taxonomy_load_report(raw, new).first()) == (1, 2)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi",\nnow'), (2, "x")], "id int, v string")
    tb.write_csv(df, str(tmp_path / "out"))
    back = tb.read_csv(spark, str(tmp_path / "out"))
    assert sorted((int(r.id), r.v) for r in back.collect()) == [(1, 'say "hi",\nnow'), (2, "x")]


def test_zombies(spark):
    rows = [
        (1, "PROCESSING", "2024-01-01 00:00:00", None),
        (2, "PROCESSING", "2024-01-01 00:05:00", None),
        (3, "PROCESSING", None, None),
        (4, "PROCESSING", "2024-01-01 00:09:00", "2024-01-01 00:00:00"),
        (5, "FAILED", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, status string, h string, s string").select(
        "id",
        "status",
        F.to_timestamp("h").alias("processing_heartbeat_at"),
        F.to_timestamp("s").alias("processing_started_at"),
        F.lit(None).cast("string").alias("processing_error"),
    )
    out = {r.id: r for r in u.rescue_zombies(df, "2024-01-01 00:10:00").collect()}
    assert {i for i, r in out.items() if r.status == "QUEUED"} == {1, 3}
    assert "zombie" in out[1].processing_error and out[1].processing_heartbeat_at is None
    assert out[2].processing_heartbeat_at is not None and out[2].processing_error is None


def queue(spark, running):
    rows = [(i, "PROCESSING", "2024-01-01") for i in range(running)]
    rows += [(10, "QUEUED", "2024-01-02"), (11, "QUEUED", "2024-01-01"), (12, "QUEUED", "2024-01-03")]
    return spark.createDataFrame(rows, "id int, status string, c string").select(
        "id", "status", F.to_timestamp("c").alias("created_at")
    )


@pytest.mark.parametrize("running, want", [(3, []), (4, []), (1, [11, 10]), (0, [11, 10, 12])])
def test_queue_slots(spark, running, want):
    df = queue(spark, running)
    chosen = u.next_in_queue(df)
    assert [r.id for r in chosen.orderBy("place").collect()] == want
    pending = u.mark_pending(df, chosen).filter("status = 'PENDING'")
    assert sorted(r.id for r in pending.collect()) == sorted(want)


def test_checkpointed_pages(spark):
    df = spark.createDataFrame(
        [(7, n, f"t{n}", "k", f"s{n}" if n != 2 else "", 10, 1, p, 2) for n, p in ((3, "b"), (1, None), (2, "a"))],
        "document_id long, page_num int, text string, keyword string, summary string, input_tokens int, "
        "output_tokens int, provider string, checkpoint int",
    )
    row = pg.roll_up(df, resume_only=True).first()
    assert (row.extracted_text, row.input_tokens, row.provider, row.page_count) == ("--- Page 3 ---\nt3", 10, "b", 3)
    whole = pg.roll_up(df, pages_per_part=1).first()
    assert whole.extracted_text == "\n\n".join(f"--- Page {n} ---\nt{n}" for n in (1, 2, 3))
    assert whole.summary == "s1\ns3"


def test_content_update_keeps_what_is_not_given(spark):
    catalog = spark.createDataFrame([(1, "f", "old", "{}", "sc")], "id long, filename string, extracted_text string, ai_analysis string, search_content string")
    catalog = catalog.withColumn("keywords", F.lit(None).cast(u._KEYWORDS_TYPE))
    content = spark.createDataFrame(
        [(1, "", None, ["k"], [], None)],
        f"id long, extracted_text string, ai_analysis string, new_keywords array<string>, new_categories array<string>, new_mappings {u.an.MAPPINGS_TYPE}",
    )
    row = u.update_content(catalog, content, "2024-01-01").first()
    assert (row.extracted_text, row.search_content, row.keywords.mapping_count) == ("old", "f k old", 0)


def test_manifest_limits(spark):
    df = spark.createDataFrame([(1, "a.b.pdf"), (2, "a.b.pdf"), (3, "noext"), (4, "noext")], "id long, filename string")
    rows = u.archive_manifest(df, [2, 99, 1, 3, 4]).orderBy("pos").collect()
    assert [r.archive_name for r in rows] == ["a.b.pdf", "a.b_1.pdf", "noext", "noext_1"]
    with pytest.raises(ValueError):
        u.archive_manifest(df, list(range(101)))
    with pytest.raises(ValueError):
        u.archive_manifest(df, [])


def test_terms_are_literal(spark):
    df = spark.createDataFrame([(1, "100% sure"), (2, "100 sure"), (3, "a_b"), (4, "axb")], "id int, v string")
    from foliary.functions.text import contains_term

    ids = lambda t, **k: [r.id for r in df.filter(contains_term(F.col("v"), t, **k)).collect()]
    assert ids("100%") == [1]
    assert ids("A_B") == [3]
    assert ids("A_B", wildcards=True) == [3, 4]


def test_editor_search_empty_input(spark):
    df = spark.createDataFrame([], ", ".join(f"{c} string" for c in flt.REVIEW_COLUMNS))
    assert flt.editor_search(df).count() == 0


def test_stream_equals_batch_for_closed_sessions(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "start"), (1, "2024-01-01 00:05:00", "heartbeat"),
            (2, "2024-01-01 00:00:00", "start"), (2, "2024-01-01 00:01:00", "complete"),
            (3, "2024-01-01 00:00:00", "heartbeat"), (3, "2024-01-01 00:06:00", "heartbeat"),
            (9, "2024-01-02 00:00:00", "complete")]
    df = spark.createDataFrame(rows, "document_id long, t string, kind string").select(
        "document_id", F.to_timestamp("t").alias("ts"), "kind"
    )
    path = str(tmp_path / "events.parquet")
    df.coalesce(1).write.parquet(path)
    batch = jobs.silent_documents(df)
    stream = jobs.run_available(
        jobs.silent_documents(spark.readStream.schema(df.schema).parquet(path)), "twin"
    )
    pick = lambda d: sorted((r.document_id, str(r.last_seen), str(r.rescued_at)) for r in d.collect())
    assert pick(stream) == pick(batch)
    # a gap of exactly the threshold is still the same session
    assert [x[0] for x in pick(batch)] == [1, 3]
