"""Batches touch their own documents, tell how far they are, and can run again."""

import pytest
from pyspark.sql import functions as F

from corpusloom.streaming import incremental


def run(spark, tmp_path):
    incremental.start(spark, str(tmp_path / "data"), str(tmp_path / "store"), str(tmp_path / "check"), 20, 5).awaitTermination()
    return str(tmp_path / "store")


def test_versions_errors_and_progress(spark, tmp_path):
    folder = tmp_path / "data"
    folder.mkdir()
    (folder / "a.txt").write_text("first text of some length")
    (folder / "b.txt").write_text("second")
    store = run(spark, tmp_path)
    (folder / "c.txt").write_text("third")
    (folder / "d.docx").write_text("of another kind")
    (folder / "e.txt").write_bytes(b"\xff\xfe no text")
    run(spark, tmp_path)
    assert sorted(r["text"] for r in incremental.current(spark, store).collect()) == ["first text of some length", "second", "third"]
    assert sorted(r["content"] for r in incremental.current_chunks(spark, store).collect()) == ["first text of some l", "ome length", "second", "third"]
    errors = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in spark.read.parquet(f"{store}/errors").collect()}
    assert errors == {"d.docx": "unsupported extension: .docx", "e.txt": "no UTF-8 text"}
    steps = incremental.progress(spark, store).orderBy("batch").collect()
    assert [(r["phase"], r["processed"], r["total"], r["error"]) for r in steps] == [("done", 2, 2, None), ("done", 3, 3, None)]
    phases = [r["phase"] for r in spark.read.parquet(f"{store}/progress").filter("batch = 1").orderBy("step").collect()]
    assert phases == ["reading", "comparing", "splitting", "done"]


def files_of(spark, rows):
    made = spark.createDataFrame(rows, "path string, text string, day int")
    return made.select("path", F.make_timestamp(F.lit(2026), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).alias("modificationTime"), F.length("text").cast("bigint").alias("length"), F.encode("text", "UTF-8").alias("content"))


def test_a_batch_opens_the_slots_of_its_documents_and_runs_again(spark, tmp_path):
    store = str(tmp_path)
    incremental.ingest_batch(files_of(spark, [(f"/data/{i}.txt", f"text {i}", 1) for i in range(600)]), 0, store, 100, 0)
    changed = files_of(spark, [("/data/3.txt", "text 3 again", 2), ("/data/3.txt", "an older version", 1), ("/data/4.txt", "text 4", 2), ("/data/new.txt", "new", 2)])
    for _ in range(2):
        incremental.ingest_batch(changed, 1, store, 100, 0)
        texts = {r["source_uri"]: r["text"] for r in incremental.current(spark, store).collect()}
        assert len(texts) == 601 and texts["file://3.txt"] == "text 3 again" and texts["file://new.txt"] == "new"
        assert incremental.current_chunks(spark, store).count() == 601
        (m,) = spark.read.parquet(f"{store}/metrics").filter("batch = 1").collect()
        assert (m["rows_in"], m["new"], m["changed"], m["unchanged"], m["rejected"]) == (4, 1, 1, 1, 0)
    slots = [r[0] for r in changed.select(incremental.slot_of(F.sha2(incremental.file_uri(F.col("path")), 256))).distinct().collect()]
    looked = incremental.versions(spark, store, slots)
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert len(slots) <= 3 and "PartitionFilters: [slot" in plan and "text" not in plan.split("ReadSchema")[1]
    assert looked.count() < 60


def test_a_failed_batch_says_so(spark, tmp_path):
    store = str(tmp_path)
    broken = files_of(spark, [("/data/1.txt", "x", 1)]).withColumn("content", F.raise_error(F.lit("the disk is gone")).cast("binary"))
    with pytest.raises(Exception, match="the disk is gone"):
        incremental.ingest_batch(broken, 0, store, 100, 0)
    (last,) = incremental.progress(spark, store).collect()
    assert last["phase"] == "failed" and "the disk is gone" in last["error"]
    incremental.ingest_batch(files_of(spark, [("/data/1.txt", "x", 1)]), 0, store, 100, 0)
    (last,) = incremental.progress(spark, store).collect()
    assert last["phase"] == "done" and incremental.current(spark, store).count() == 1
