from pyspark.sql import functions as F

from ledgerlens.operators import merge
from ledgerlens.sources import files
from ledgerlens.streaming import upserts


def test_files(spark, tmp_path):
    (tmp_path / "catalog.csv").write_text("doc_id,year,company,pdf_path,pdf_url\na_2023,2023, Alpha ,a.pdf,\n,2024,x,y,z\n")
    got = files.read_catalog(spark, str(tmp_path / "catalog.csv")).collect()
    assert [(r.doc_id, r.year, r.company, r.display_name) for r in got] == [("a_2023", 2023, "Alpha", None)]
    (tmp_path / "gold.csv").write_text("doc_id;field_id;unit;value\na;f;EUR; 1.5 \n;f;EUR;2\nb;f;EUR;\n")
    assert [(r.doc_id, r.value) for r in files.read_gold(spark, str(tmp_path / "gold.csv")).orderBy("doc_id").collect()] == [("a", 1.5), ("b", None)]
    (tmp_path / "o.yaml").write_text("- {doc_id: a, field_id: f, value_canonical: 1}\n- text\n- {doc_id: b}\n")
    assert files.read_overrides(spark, str(tmp_path / "o.yaml")).count() == 1
    assert files.read_overrides(spark, str(tmp_path / "none.yaml")).count() == 0
    (tmp_path / "f.yaml").write_text("fields:\n  - {id: scr_total, unit: EUR, typical_scale: 1000, keywords: [SCR]}\n")
    assert files.read_fields(spark, str(tmp_path / "f.yaml")).head().subsection_hint == "E"
    (tmp_path / "x.extractions.jsonl").write_text('{"doc_id":"a","field_id":"f","verified":true,"evidence":[{"page":3}]}\n\n')
    assert files.read_extractions(spark, str(tmp_path), "ok").head().status == "ok"
    assert files.list_files(spark, str(tmp_path), "*.csv").count() == 2


def test_stream_upserts_are_idempotent(spark, tmp_path):
    schema = "k string, v int, seq int"
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k":"a","v":1,"seq":1}\n{"k":"a","v":2,"seq":2}\n{"k":"b","v":1,"seq":1}\n')
    args = (str(tmp_path / "table"), ["k"], "seq", str(tmp_path / "checkpoint"))
    upserts.upsert_batches(upserts.stream_jsonl(spark, str(tmp_path / "in"), schema), *args).awaitTermination()
    (tmp_path / "in/b.json").write_text('{"k":"b","v":5,"seq":3}\n')
    upserts.upsert_batches(upserts.stream_jsonl(spark, str(tmp_path / "in"), schema), *args).awaitTermination()
    assert sorted((r.k, r.v) for r in upserts.current(spark, args[0], schema).collect()) == [("a", 2), ("b", 5)]


def test_gold_keeps_its_order(spark, tmp_path):
    (tmp_path / "gold.csv").write_text("doc_id,field_id,unit,value\nz,f,EUR,1\na,f,EUR,2\nz,f,%,3\n")
    gold = files.read_gold(spark, str(tmp_path / "gold.csv"), sep=",")
    predictions = spark.createDataFrame([("m", "f", "EUR", True, 1), ("b", "f", "EUR", True, 2), ("a", "f", "EUR", True, 3)], "doc_id string, field_id string, unit string, verified boolean, seq int")
    files.write_gold(merge.gold_merge(gold, predictions, True, [F.col("seq")]), str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().split("\n")[1:] if x]
    assert [x.split(",")[:3] for x in lines] == [["z", "f", "%"], ["a", "f", "EUR"], ["b", "f", "EUR"], ["m", "f", "EUR"]]


def test_backup_report_and_refresh(spark, tmp_path):
    (tmp_path / "g.csv").write_text("x")
    assert files.backup(spark, str(tmp_path / "g.csv")) and (tmp_path / "g.csv.bak").read_text() == "x"
    assert not files.backup(spark, str(tmp_path / "none.csv"))
    files.write_report(spark.createDataFrame([("a\nb",)], "report string"), str(tmp_path / "report"))
    assert "".join(f.read_text() for f in (tmp_path / "report").glob("part-*")) == "a\nb\n"
    rows = spark.createDataFrame([("d", 1.0)], "doc_id string, value double")
    for table in (rows, rows.unionByName(rows)):
        assert files.refresh_final_values(table, str(tmp_path / "final")) == table.count()


def test_upserts_keep_few_versions(spark, tmp_path):
    schema = "k int, v int, seq int"
    (tmp_path / "in").mkdir()
    args = (str(tmp_path / "table"), ["k"], "seq", str(tmp_path / "checkpoint"))
    for n in range(4):
        (tmp_path / f"in/{n}.json").write_text("".join(f'{{"k":{k},"v":{n},"seq":{n}}}\n' for k in (range(40) if not n else [7])))
        upserts.upsert_batches(upserts.stream_jsonl(spark, str(tmp_path / "in"), schema), *args, buckets=8).awaitTermination()
    got = {r.k: r.v for r in upserts.current(spark, args[0], schema).collect()}
    assert got == {k: 3 if k == 7 else 0 for k in range(40)}
    assert len(list((tmp_path / "table").glob("version=*/bucket=*"))) == 8 + 1
