"""Readers and writers on scratch files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ebbtide.sources import corpora as co
from ebbtide.sources import exchange as ex
from ebbtide.sources import files as fl
from ebbtide.sources import prompt_sets as ps
from ebbtide.sources import snapshots as sn


def texts(df):
    return [r.text for r in df.collect()]


def test_lines_drop_bad_bytes(spark, tmp_path):
    path = tmp_path / "a.txt"
    path.write_bytes("café\n".encode() + b"ba\xffd\n\nlast")
    assert texts(co.read_lines(spark, str(path))) == ["café", "bad", "", "last"]


def test_csv_column_choice(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,text\n1,"two\nlines"\n2,\n3,NA\n4,"say ""hi"""\n')
    assert texts(co.read_csv_corpus(spark, str(tmp_path / "t.csv"))) == ["two\nlines", 'say "hi"']
    (tmp_path / "s.csv").write_text("id,body\n1,hello\n2,world\n")
    assert texts(co.read_csv_corpus(spark, str(tmp_path / "s.csv"))) == ["hello", "world"]
    (tmp_path / "n.csv").write_text("id,n\n1,2\n3,4\n")
    assert texts(co.read_csv_corpus(spark, str(tmp_path / "n.csv"))) == ["1", "3"]


def test_json_readers(spark, tmp_path):
    entries = [{"text": "x"}, "bare", {"text": 5}, {"other": 1}, 3, {"text": None}, {"text": True}]
    (tmp_path / "a.json").write_text(json.dumps(entries, indent=1))
    assert texts(co.read_json_corpus(spark, str(tmp_path / "a.json"))) == ["x", "bare", "5", "True"]
    (tmp_path / "c.json").write_text(json.dumps({"text": ["p", 2, None]}))
    assert texts(co.read_json_corpus(spark, str(tmp_path / "c.json"))) == ["p", "2", "None"]
    lines = ['{"text": "x"}', "", "{broken", '"bare"', "[1]", '{"text": null}', '{"no": 1}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    assert texts(co.read_jsonl_corpus(spark, str(tmp_path / "a.jsonl"))) == ["x", "bare"]


def test_default_corpus_needs_text(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        co.read_default_corpus(spark, str(tmp_path / "p"))
    assert sorted(texts(co.read_parquet_corpus(spark, str(tmp_path / "p")))) == ["0", "1", "2"]


def test_prompt_set_formats_keep_order(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\ntwo\n   \nthree\n")
    rows = ps.read_txt_prompts(spark, str(tmp_path / "a.txt")).collect()
    assert sorted((r.position, r.record["input_text"]) for r in rows) == [(0, "one"), (1, "two"), (2, "three")]
    (tmp_path / "a.json").write_text(json.dumps(["s", {"prompt": "p"}, 4, {"z": "q"}]))
    rows = ps.read_json_prompts(spark, str(tmp_path / "a.json")).collect()
    assert [(r.position, r.record) for r in sorted(rows, key=lambda r: r.position)] == [
        (0, {"input_text": "s"}), (1, {"prompt": "p"}), (2, {"z": "q"}),
    ]
    (tmp_path / "a.csv").write_text("prompt,tag\nhello,x\n,y\n")
    rows = ps.read_csv_prompts(spark, str(tmp_path / "a.csv")).collect()
    assert sorted((r.position, r.record["prompt"], r.record["tag"]) for r in rows) == [(0, "hello", "x"), (1, "", "y")]


def test_ingestion_rules(spark, tmp_path):
    lines = [
        {"input_text": " a ", "prompt": "b", "k": "v"},
        {"input_text": "", "prompt": "b"},
        {"input_text": "   ", "prompt": "b"},
        {"z": " ", "y": "first other", "x": "second"},
        {"input_text": 0, "text": "t"},
        {"input_text": 7},
        {"z": None},
        {"prompt": False, "y": "kept"},
    ]
    (tmp_path / "p.jsonl").write_text("\n".join(json.dumps(x) for x in lines) + "\n{bad\n")
    records = ps.read_jsonl_prompts(spark, str(tmp_path / "p.jsonl"))
    sets = spark.createDataFrame([("p",), ("p-2",), ("p-4",), ("p-x",), ("p-03",)], "name string")
    name, items, counts = ps.ingest(records, sets, None, "up/p.jsonl")
    assert name == "p-3"
    got = {r.position: (r.input_text, r.metadata) for r in items.collect()}
    assert {k: v[0] for k, v in got.items()} == {0: "a", 1: "b", 3: "first other", 4: "t", 5: "7", 7: "false"}
    assert got[0][1] == {"k": "v"}
    assert tuple(counts.first()) == (6, 2)
    assert ps.unique_name(sets, "new") == "new"
    with pytest.raises(ValueError):
        ps.ingest(records.limit(0), sets, "n", "f.jsonl")


def test_export_formats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, ["a", 'q"'])], "prompt_id long, model_version_id long, tokens array<string>")
    ex.write_export(ex.export_rows("prompts", rows, version_id=5), str(tmp_path / "c"), "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert json.loads(back.tokens) == ["a", 'q"']
    assert ex.export_rows("metrics", rows, version_id=99).count() == 1
    assert ex.export_rows("prompts", rows, version_id=99).count() == 0
    with pytest.raises(ValueError):
        ex.export_rows("users", rows)


def test_import_all_or_nothing(spark, tmp_path):
    bad = spark.createDataFrame([(0, "m", "active"), (1, None, "active"), (2, "n", "odd")], "index long, name string, status string")
    imported, errors = ex.import_records(bad, "models", str(tmp_path / "models"))
    assert imported == 0 and not (tmp_path / "models").exists()
    assert {r["index"]: r.error for r in errors.collect()} == {1: "name: field required", 2: "status: unknown value"}
    assert ex.failure_notification(errors).first().message == "Import failed with 2 errors."
    imported, errors = ex.import_records(bad.where("index = 0"), "models", str(tmp_path / "models"))
    assert imported == 1 and ex.failure_notification(errors).isEmpty()
    assert spark.read.parquet(str(tmp_path / "models")).first().name == "m"
    typed = spark.createDataFrame([(0, "7", '{"a":0.5}', "maybe")], "index long, prompt_id string, token_frequency string, is_anomaly string")
    row = ex.validate(typed, "metrics").first()
    assert row.token_frequency == {"a": 0.5} and row.errors == ["is_anomaly: not a valid boolean"]


def test_snapshot_round_trip(spark, tmp_path):
    table = spark.createDataFrame([(1, "a")], "id long, name string")
    folder = sn.write_snapshot({"models": table}, str(tmp_path), datetime(2024, 5, 6, 7, 8, 9))
    assert folder.endswith("snapshot_20240506_070809")
    schemas = {"models": "id bigint, name string", "users": "id bigint"}
    for _ in range(2):
        sn.restore_snapshot(spark, folder, str(tmp_path / "t"), schemas)
    assert spark.read.parquet(str(tmp_path / "t/models")).count() == 2
    sn.restore_snapshot(spark, folder, str(tmp_path / "t"), schemas, replace=True)
    assert spark.read.parquet(str(tmp_path / "t/models")).count() == 1
    assert spark.read.parquet(str(tmp_path / "t/users")).count() == 0


def test_snapshot_checks_leave_the_target_alone(spark, tmp_path):
    ddl = "id bigint, name string, tags map<string,double>, parts array<string>"
    tables = {"models": spark.createDataFrame([(1, "a", {"x": 1.0}, ["p"]), (2, None, None, None)], ddl), "users": spark.range(3)}
    schemas, target = {"models": ddl, "users": "id bigint", "empty": "id bigint"}, str(tmp_path / "t")
    spark.createDataFrame([(9, "old", None, None)], ddl).write.parquet(f"{target}/models")

    def held():
        return {n: spark.read.schema(s).parquet(f"{target}/{n}").count() for n, s in schemas.items() if (tmp_path / "t" / n).exists()}

    with pytest.raises(FileNotFoundError):
        sn.restore_snapshot(spark, str(tmp_path / "none"), target, schemas, replace=True)
    folder = sn.write_snapshot(tables, str(tmp_path), datetime(2024, 1, 1))
    manifest = tmp_path / "snapshot_20240101_000000" / "_manifest.d"
    manifest.rename(tmp_path / "aside")
    with pytest.raises(ValueError, match="unfinished"):
        sn.restore_snapshot(spark, folder, target, schemas, replace=True)
    (tmp_path / "aside").rename(manifest)
    (tmp_path / "snapshot_20240101_000000" / "users").rename(tmp_path / "users")
    with pytest.raises(ValueError, match="damaged"):
        sn.restore_snapshot(spark, folder, target, schemas, replace=True)
    spark.range(1, 4).write.parquet(f"{folder}/users")  # as many rows, other content
    with pytest.raises(ValueError, match="damaged"):
        sn.restore_snapshot(spark, folder, target, schemas, replace=True)
    assert held() == {"models": 1} and [p.name for p in (tmp_path / "t").iterdir()] == ["models"]
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/users")
    sn.restore_snapshot(spark, folder, target, schemas, replace=True)
    assert held() == {"models": 2, "users": 3, "empty": 0}
    sn.restore_snapshot(spark, folder, target, schemas)
    assert held() == {"models": 4, "users": 6, "empty": 0}
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["empty", "models", "users"]


def test_a_failed_restore_is_rolled_back(spark, tmp_path, monkeypatch):
    folder = sn.write_snapshot({"a": spark.range(3), "b": spark.range(4)}, str(tmp_path), datetime(2024, 1, 1))
    target, schemas = str(tmp_path / "t"), {"a": "id bigint", "b": "id bigint"}
    spark.range(1).write.parquet(f"{target}/a")
    spark.range(2).write.parquet(f"{target}/b")
    move = sn._Files.move

    def failing(self, old, new):
        if old.endswith("new/b") or "new/b/part" in old:
            raise OSError("store is gone")
        move(self, old, new)

    monkeypatch.setattr(sn._Files, "move", failing)
    for replace in (True, False):
        with pytest.raises(OSError):
            sn.restore_snapshot(spark, folder, target, schemas, replace=replace)
        assert [spark.read.parquet(f"{target}/{n}").count() for n in "ab"] == [1, 2]
        assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["a", "b"]


def test_report_keeps_pairs_without_changes(spark, tmp_path):
    ddl = "version_1 long, version_2 long, metric string, value_1 double, value_2 double, delta double, percent_change double, highlight boolean"
    changes = spark.createDataFrame([(1, 2, "m", 1.0, 2.0, 1.0, 100.0, True)], ddl)
    metrics = spark.createDataFrame([(1, "m", 1.0), (2, "m", 2.0), (3, "k", None)], "model_version_id long, metric string, value double")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "version_1 long, version_2 long")
    sn.write_report(changes, metrics, str(tmp_path / "r"), "json", pairs)
    rows = {(r["version_1"], r["version_2"]): r for p in (tmp_path / "r").glob("part-*") for r in map(json.loads, p.read_text().splitlines())}
    assert set(rows) == {(1, 2), (2, 3), (3, 4)} and [len(rows[k]["changes"]) for k in sorted(rows)] == [1, 0, 0]
    assert rows[2, 3]["metrics_2"] == {"k": None} and rows[3, 4]["metrics_2"] == {}


def test_broken_json_raises_and_files_keep_their_order(spark, tmp_path):
    folder = tmp_path / "sets"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(["a0", 5, {"prompt": "a1"}]))
    (folder / "b.json").write_text(json.dumps([{"prompt": "b0"}, "b1"], indent=1))
    rows = sorted((r.position, *r.record.values()) for r in ps.read_json_prompts(spark, str(folder)).collect())
    assert rows == [(0, "a0"), (1, "a1"), (2, "b0"), (3, "b1")]
    (folder / "c.json").write_text('["c0", {"prom')
    for read in (ps.read_json_prompts, co.read_json_corpus):
        with pytest.raises(Exception, match="not a JSON document.*c.json"):
            read(spark, str(folder)).collect()
    assert [r.file.rsplit("/", 1)[-1] for r in fl.unreadable_files(fl.json_files(spark, str(folder))).collect()] == ["c.json"]


def test_import_files_have_record_numbers(spark, tmp_path):
    folder = tmp_path / "csv"
    folder.mkdir()
    (folder / "a.csv").write_text('name,status\nm1,active\n"two\nlines",odd\n')
    (folder / "b.csv").write_text("name,status\n,active\nm4,testing\n")
    errors = ex.error_rows(ex.validate(ex.read_import_csv(spark, str(folder)), "models"))
    assert {r["index"]: r.error for r in errors.collect()} == {1: "status: unknown value", 2: "name: field required"}
    folder = tmp_path / "json"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([{"name": "m0"}, 7, {"status": "active"}]))
    (folder / "b.json").write_text(json.dumps([{"name": "m3", "status": "odd"}, {"name": "m4", "extra": [1]}, {"name": None}]))
    rows = ex.validate(ex.read_import_json(spark, str(folder), "models"), "models")
    errors = {r["index"]: r.error for r in ex.error_rows(rows).collect()}
    assert errors == {1: "not a record", 2: "name: field required", 3: "status: unknown value", 5: "name: field required"}
    nested = tmp_path / "n.json"
    nested.write_text(json.dumps([{"prompt_id": 1, "token_frequency": {"a": 0.5}, "anomaly_reasons": ["x"], "is_anomaly": True}]))
    row = ex.validate(ex.read_import_json(spark, str(nested), "metrics"), "metrics").first()
    assert (row.prompt_id, row.token_frequency, row.anomaly_reasons, row.is_anomaly, row.errors) == (1, {"a": 0.5}, ["x"], True, [])
    (tmp_path / "o.json").write_text('{"name": "x"}')
    with pytest.raises(Exception, match="array of records"):
        ex.read_import_json(spark, str(tmp_path / "o.json"), "models").collect()


def test_evaluation_slice(spark):
    rows = [(i, "x" * n) for i, n in enumerate([60, 50, 51, 1001, 1000, 70])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in co.evaluation_slice(df, "doc_id", 1, 2, 1000).orderBy(F.col("doc_id")).collect()]
    assert got == [2, 4]
