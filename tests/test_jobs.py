import pytest
from pyspark.sql import functions as F

from quarrybed import jobs
from quarrybed.operators import report
from quarrybed.streaming import incremental


def test_replace_is_idempotent_and_keeps_other_sources(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "source_id bigint, v string")
    incremental.replace_by_source(first, path)
    incremental.replace_by_source(first, path)
    incremental.replace_by_source(spark.createDataFrame([(1, "z")], "source_id bigint, v string"), path)
    assert sorted((r.source_id, r.v) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]


def test_stream_processes_new_files_once(spark, tmp_path):
    src, sink, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "source_id bigint, v string"
    spark.createDataFrame([(1, "a"), (2, "b")], schema).write.mode("append").parquet(src)
    work = lambda df: df.withColumn("v", F.upper("v"))
    incremental.run_stream(spark, src, schema, work, sink, ck).awaitTermination()
    spark.createDataFrame([(2, "n")], schema).write.mode("append").parquet(src)
    incremental.run_stream(spark, src, schema, work, sink, ck).awaitTermination()
    incremental.run_stream(spark, src, schema, work, sink, ck).awaitTermination()
    assert sorted((r.source_id, r.v) for r in spark.read.parquet(sink).collect()) == [(1, "A"), (2, "N")]


def test_upsert_and_ordinals(spark):
    a = spark.createDataFrame([(1, 1, "old"), (2, 5, "keep")], "k bigint, ver bigint, v string")
    b = spark.createDataFrame([(1, 1, "new"), (2, 4, "late")], "k bigint, ver bigint, v string")
    assert sorted((r.k, r.v) for r in incremental.upsert(a, b, ["k"], "ver").collect()) == [(1, "new"), (2, "keep")]
    assert [r.ordinal for r in incremental.stage_ordinals(a, "k", "ver").collect()] == ["0" * 20] * 2


def test_progress_with_its_own_clock():
    now = [0.0]
    p = jobs.Progress(100, clock=lambda: now[0])
    for t, done in ((0, 0), (0.1, 5), (1, 10), (2, 20)):
        now[0] = t
        p.update(done)
    assert p.rate() == 10 and p.snapshot()["eta_seconds"] == 8 and len(p.samples) == 3
    now[0] = 8
    assert p.rate() is None  # stalled
    assert jobs.eta_seconds(1, 0, 5) == 0 and jobs.Progress(0).snapshot()["percent"] == 0


def test_passes_are_isolated_and_statuses_fold(spark):
    got = jobs.run_passes(spark, {"good": lambda: 1, "bad": lambda: 1 / 0, "after": lambda: 2})
    assert [r["status"] for r in got] == ["complete", "failed", "complete"] and jobs.fold_status([r["status"] for r in got]) == "failed"
    assert jobs.fold_status(["complete", "truncated"]) == "truncated" and jobs.fold_status([]) == "complete"
    assert jobs.truncation_reasons(["a", "b", "a"], 1) == {"reasons": ["a"], "total": 3, "omitted": 1}
    df, o = jobs.observed(spark.range(7), "x", top=F.max("id"))
    df.collect()
    assert o.get == {"rows": 7, "top": 6}


def test_audit_report_and_export(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(2):
        jobs.append_audit(spark, path, "export", "me", "entry", i, {"n": i})
    assert sorted(r.details_json for r in spark.read.parquet(path).collect()) == ['{"n": 0}', '{"n": 1}']
    page, digest = report.render("a<b", [{"name": "F", "items": [{"display_name": "x&y", "logical_path": "/p"}]}])
    assert "a&lt;b" in page and "x&amp;y" in page and digest in page
    files = spark.createDataFrame([("A.txt", b"1", 1), ("a.TXT", b"2", 2), ("../up", b"3", 3), ("none", None, 4)], "path string, bytes binary, o int")
    named = report.unique_names(files, "path", "o")
    assert sorted(r.output_name for r in named.collect()) == ["../up", "A.txt", "a (2).TXT", "none"]
    folder = tmp_path / "out"
    folder.mkdir()
    got = {r.output_name: r.status for r in report.export_files(named, str(folder)).collect()}
    assert got["none"] == "skipped: no data" and got["A.txt"] == "written" and sorted(x.name for x in folder.iterdir()) == ["A.txt", "a (2).TXT", "up"]
    with pytest.raises(FileExistsError):
        report.write_new(str(folder / "A.txt"), b"again")
    assert (folder / "A.txt").read_bytes() == b"1" and report.manifest_csv([('a"b', 1, "h")]).splitlines()[1] == '"a""b","1","h"'
    assert report.category_key("|||x") == (None, "x") and report.category_key("m") == ("m", None)
