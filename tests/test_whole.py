"""Queries that run over all rows of a table, compared with brute force on rows that narrower queries leave out."""

import duckdb

from quarrybed.plans import catalogue


def test_all_mails(spark, tmp_path):
    long = "Größe der Übergabe – Añeta, 哰嚬廩, 😀 " * 6
    heads = [("Ann <a@x.test>", "plain", "<1@x>"), ("Zoë Ingström <z@x.test>", long, "<2@x>"), ("A  B <b@x.test>", "a =?utf-8?q?b?= c", None), ("C", None, "<4@x>"), (None, " ß  two ", None), (None, None, None), ("", "line\r\nTo: x", "<ü@x>")]
    rows = [(i, *h, "body: x\n\nÜ") for i, h in enumerate(heads)]
    spark.createDataFrame(rows + rows[:2], "entry_id bigint, from_header string, subject string, message_id string, body_preview string").write.parquet(f"{tmp_path}/rfc822_metadata.parquet")
    got = {tuple(r) for r in catalogue.eml_parse(spark, str(tmp_path)).collect()}
    assert got == {(i, *(h if h is None else " ".join(h.split()) for h in hs)) for i, hs in enumerate(heads)}


def test_offsets_in_all_texts(spark, tmp_path):
    texts = ["hashed again", "über 😀 hashed again, hashed again", "e\u0301 哰嚬 hashed again", "plain hashed again", "Hashed again ß", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, t.encode().find(b"hashed again")) for i, t in enumerate(texts) if t and "hashed again" in t}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert want == set(con.execute(catalogue.oracle_sql()["content_offset"]).fetchall())
    assert {tuple(r) for r in catalogue.content_offset(spark, str(tmp_path)).collect()} == want


def test_trees_say_what_they_omit(spark, tmp_path):
    paths = [(1, f"/v/d{i % 50:02}/f{i:04}.txt") for i in range(2003)] + [(2, "\\\\a\\b"), (2, "a/b"), (2, "a/b"), (2, "//"), (2, None), (None, "/x/y")]
    spark.createDataFrame(paths, "evidence_id bigint, logical_path string").write.parquet(f"{tmp_path}/filesystem_entries.parquet")
    split = {(e, tuple(x for x in p.replace("\\", "/").split("/") if x), p) for e, p in paths if p}
    want = set()
    for e in (1, 2, None):
        rows = sorted(r[1:] for r in split if r[0] == e and r[1])
        want |= {(e, k, p, len(parts) - 1, parts[-1], len(rows), max(len(rows) - 2000, 0)) for k, (parts, p) in enumerate(rows[:2000], 1)}
    got = [tuple(r) for r in catalogue.tree_lines(spark, str(tmp_path)).collect()]
    assert len(got) == 2003 and set(got) == want and {r[6] for r in got if r[0] == 1} == {3}
