"""Readers, ingestion, export, import, snapshots: files are written from the tables to the shared folder first."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ebbtide.session import shared_dir
from ebbtide.sources import corpora as co
from ebbtide.sources import exchange as ex
from ebbtide.sources import prompt_sets as ps
from ebbtide.sources import snapshots as sn
from workload import tables as tb
from workload.registry import query
from workload.rollup_queries import CHANGES, HIGHLIGHT, _changes, _current, _pairs

MOMENT = datetime(2024, 2, 1, 12, 30, 0)


def digests(df):
    """Multiset of texts as digest and count."""
    return df.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


DIGEST = "SELECT md5(text) AS digest, count(*) AS n FROM t GROUP BY ALL"


@query("S01_text_lines", f"WITH t AS (SELECT unnest(string_split(text, chr(10))) AS text FROM documents) {DIGEST}")
def s01(spark, d):
    path = shared_dir(spark, "lines")
    tb.documents(spark, d).select("text").write.text(path)
    return digests(co.read_lines(spark, path))


@query("S02_parquet_first_string", "WITH t AS (SELECT url AS text FROM pages) " + DIGEST)
def s02(spark, d):
    """``pages`` has no text column: the first string column is taken."""
    return digests(co.read_parquet_corpus(spark, f"{d}/pages.parquet"))


@query("S02_csv_text_column", f"WITH t AS (SELECT text FROM documents WHERE doc_id % 7 <> 0) {DIGEST}")
def s02b(spark, d):
    path = shared_dir(spark, "csv")
    text = F.when(F.col("doc_id") % 7 != 0, F.col("text"))
    tb.documents(spark, d).select("doc_id", "lang", text.alias("text")).write.option("header", True).option("escape", '"').csv(path)
    return digests(co.read_csv_corpus(spark, path))


@query(
    "S03_jsonl_corpus",
    f"WITH t AS (SELECT CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text ELSE CAST(doc_id AS VARCHAR) END AS text FROM documents WHERE doc_id % 6 IN (0, 1, 2)) {DIGEST}",
)
def s03(spark, d):
    """Objects, bare strings, numbers as text, NULL texts, malformed and blank lines, mixed."""
    kind, text = F.col("doc_id") % 6, F.col("text")
    quoted = F.expr("substr(to_json(struct(text AS t)), 6, length(to_json(struct(text AS t))) - 6)")
    line = (
        F.when(kind == 0, F.to_json(F.struct("text", "lang")))
        .when(kind == 1, quoted)
        .when(kind == 2, F.to_json(F.struct(F.col("doc_id").alias("text"))))
        .when(kind == 3, F.lit('{"text": null}'))
        .when(kind == 4, F.concat(F.lit('{"text": '), F.col("doc_id").cast("string")))
        .otherwise(F.lit("   "))
    )
    path = shared_dir(spark, "jsonl")
    tb.documents(spark, d).select("doc_id", "lang", text).select(line.alias("value")).write.text(path)
    return digests(co.read_jsonl_corpus(spark, path))


@query(
    "S04_json_corpus",
    f"WITH t AS (SELECT text FROM documents WHERE doc_id % 3 <> 2) {DIGEST}",
)
def s04(spark, d):
    """Files holding one JSON array of objects, strings and numbers each; numbers are ignored."""
    quoted = F.expr("substr(to_json(struct(text AS t)), 6, length(to_json(struct(text AS t))) - 6)")
    entry = (
        F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct("text", "doc_id")))
        .when(F.col("doc_id") % 3 == 1, quoted)
        .otherwise(F.col("doc_id").cast("string"))
    )
    # one file per 128 neighbouring ids: a JSON document is a single value and stays small
    docs = tb.documents(spark, d).select("doc_id", "text").withColumn("file", F.floor(F.col("doc_id") / 128))
    files = docs.groupBy("file").agg(F.concat(F.lit("["), F.array_join(F.collect_list(entry), ","), F.lit("]")).alias("value"))
    path = shared_dir(spark, "json")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return digests(co.read_json_corpus(spark, path))


@query("S05_default_corpus", f"WITH t AS (SELECT text FROM documents) {DIGEST}")
def s05(spark, d):
    return digests(co.read_default_corpus(spark, f"{d}/documents.parquet"))


@query(
    "S17_evaluation_slice",
    "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id >= 30 AND length(text) > 50 AND length(text) <= 1000 ORDER BY doc_id LIMIT 500",
)
def s17(spark, d):
    """The slice is written as JSON lines and read back."""
    rows = co.evaluation_slice(tb.documents(spark, d).select("doc_id", "text"), "doc_id", 30, 500, 1000)
    path = shared_dir(spark, "slice")
    rows.write.json(path)
    return spark.read.schema("doc_id bigint, text string").json(path).select("doc_id", F.md5("text").alias("digest"))


@query(
    "S08_prompt_set_reader",
    """SELECT conv_id * 100 + turn AS id, role, md5(text) AS digest FROM conversations WHERE turn % 4 <> 3""",
)
def s08(spark, d):
    """Conversation turns as a JSON-lines prompt set; every fourth turn is a malformed line and is skipped."""
    turns = tb.table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", "text", "turn")
    line = F.when(F.col("turn") % 4 == 3, F.lit("{broken")).otherwise(F.to_json(F.struct("id", "role", "text")))
    path = shared_dir(spark, "prompts")
    turns.select(line.alias("value")).write.text(path)
    rows = ps.read_jsonl_prompts(spark, path)
    part = lambda k: F.try_element_at("record", F.lit(k))
    return rows.select(part("id").cast("long").alias("id"), part("role").alias("role"), F.md5(part("text")).alias("digest"))


@query(
    "S08_txt_prompt_set",
    """WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '' ELSE replace(text, chr(10), ' ') END AS line FROM conversations),
k AS (SELECT trim(line, E' \n\t\r') AS line, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM l WHERE trim(line, E' \n\t\r') <> '')
SELECT position, md5(line) AS digest FROM k""",
)
def s08_txt(spark, d):
    """One prompt per line, blank lines skipped; positions follow the files."""
    turns = tb.table(spark, d, "conversations")
    line = F.when(F.col("turn") % 5 == 4, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.replace("text", F.lit("\n"), F.lit(" "))))
    path = shared_dir(spark, "prompts")
    turns.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select(line.alias("value")).write.text(path)
    rows = ps.read_txt_prompts(spark, path)
    return rows.select("position", F.md5(F.try_element_at("record", F.lit("input_text"))).alias("digest"))


@query(
    "S08_csv_prompt_set",
    """SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS position, md5(CASE WHEN turn % 3 = 1 THEN '' ELSE text END) AS digest, role FROM conversations""",
)
def s08_csv(spark, d):
    """A header row names the keys; an empty cell is an empty text, line breaks inside quotes belong to the cell."""
    turns = tb.table(spark, d, "conversations")
    text = F.when(F.col("turn") % 3 != 1, F.col("text"))
    path = shared_dir(spark, "prompts")
    ordered = turns.repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    ordered.select(text.alias("prompt"), "role").write.option("header", True).option("escape", '"').csv(path)
    part = lambda k: F.try_element_at("record", F.lit(k))
    return ps.read_csv_prompts(spark, path).select("position", F.md5(part("prompt")).alias("digest"), part("role").alias("role"))


def _json_arrays(spark, rows, file, order, entry):
    """Files of one JSON array each, named by the ``file`` number so that they sort in its order."""
    docs = rows.groupBy(file.alias("_n")).agg(F.sort_array(F.collect_list(F.struct(*order, entry.alias("_e")))).alias("_l"))
    value = F.concat(F.lit("["), F.array_join(F.transform("_l", lambda r: r["_e"]), ","), F.lit("]"))
    path = shared_dir(spark, "json-arrays")
    # a folder per file: the number leads the path
    docs.select(F.lpad(F.col("_n").cast("string"), 9, "0").alias("part"), value.alias("value")).write.partitionBy("part").text(path)
    return path


@query(
    "S08_json_prompt_set",
    """WITH k AS (SELECT conv_id, turn, text, turn % 4 AS t FROM conversations)
SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS position, CASE t WHEN 1 THEN 'input_text' ELSE 'prompt' END AS key, md5(text) AS digest FROM k WHERE t <> 3""",
)
def s08_json(spark, d):
    """Several files of one array each: objects and bare strings count, numbers do not; files keep their order."""
    t = F.col("turn") % 4
    quoted = F.expr("substr(to_json(struct(text AS t)), 6, length(to_json(struct(text AS t))) - 6)")
    entry = F.when(t == 3, F.col("turn").cast("string")).when(t == 1, quoted).otherwise(F.to_json(F.struct(F.col("text").alias("prompt"))))
    path = _json_arrays(spark, tb.table(spark, d, "conversations"), F.floor(F.col("conv_id") / 500), ["conv_id", "turn"], entry)
    keys = F.map_keys("record")
    return ps.read_json_prompts(spark, path).select(
        "position", F.get(keys, F.lit(0)).alias("key"), F.md5(F.get(F.map_values("record"), F.lit(0))).alias("digest")
    )


PROMPT_RULE = """r AS (SELECT conv_id, turn, role, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN '   ' ELSE role END AS chosen FROM conversations)"""


def _records(spark, d):
    """Turns as records: prompt key, text key after an empty prompt, blank text, no preferred key at all."""
    turns = tb.table(spark, d, "conversations")
    t = F.col("turn") % 4
    raw = (
        F.when(t == 0, F.to_json(F.struct(F.col("text").alias("prompt"), "role")))
        .when(t == 1, F.to_json(F.struct(F.lit("").alias("prompt"), "text", "role")))
        .when(t == 2, F.to_json(F.struct(F.lit("   ").alias("prompt"), "text", "role")))
        .otherwise(F.to_json(F.struct(F.lit(" ").alias("note"), "role", "turn")))
    )
    rows = turns.select("conv_id", "turn", raw.alias("raw"))
    return rows.withColumn("record", F.from_json("raw", "map<string,string>"))


@query(
    "S09_prompt_set_ingestion",
    f"WITH {PROMPT_RULE} SELECT conv_id, turn, md5(trim(chosen, E' \\n\\t\\r')) AS digest, CASE turn % 4 WHEN 3 THEN 'note,role,turn' ELSE 'role' END AS metadata_keys FROM r WHERE trim(chosen) <> ''",
)
def s09(spark, d):
    chosen = ps.choose_prompts(_records(spark, d)).where(F.col("candidate").isNotNull())
    keys = F.array_join(F.array_sort(F.map_keys("metadata")), ",")
    return chosen.select("conv_id", "turn", F.md5("candidate").alias("digest"), keys.alias("metadata_keys"))


@query(
    "S09_prompt_set_upload",
    """WITH l AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 2 THEN '   ' ELSE text END AS prompt FROM conversations),
k AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS position FROM l), n AS (SELECT count(*) FILTER (trim(prompt, E' \n\t\r') <> '') AS accepted, count(*) FILTER (trim(prompt, E' \n\t\r') = '') AS skipped FROM k)
SELECT 'turns-' || (SELECT max(n_regionkey) + 2 FROM nation) AS set_name, position, md5(trim(prompt, E' \n\t\r')) AS digest, role, accepted, skipped FROM k, n WHERE trim(prompt, E' \n\t\r') <> ''""",
)
def s09_upload(spark, d):
    """A whole upload: unique set name, accepted items with their position in the file, counts of both outcomes."""
    turns = tb.table(spark, d, "conversations").repartitionByRange(4, "conv_id", "turn").sortWithinPartitions("conv_id", "turn")
    prompt = F.when(F.col("turn") % 3 == 2, F.lit("   ")).otherwise(F.col("text"))
    path = shared_dir(spark, "upload")
    turns.select(F.to_json(F.struct(prompt.alias("prompt"), "role")).alias("value")).write.text(path)
    # names taken so far: turns, turns-2, ..., one per region
    number = F.col("n_regionkey")
    taken = tb.table(spark, d, "nation").select(
        F.when(number == 0, F.lit("turns")).otherwise(F.concat(F.lit("turns-"), (number + 1).cast("string"))).alias("name")
    )
    name, items, counts = ps.ingest(ps.read_jsonl_prompts(spark, path), taken, None, "uploads/turns.jsonl")
    rows = items.select(F.lit(name).alias("set_name"), "position", F.md5("input_text").alias("digest"), F.try_element_at("metadata", F.lit("role")).alias("role"))
    return rows.withColumn("accepted", counts.select("accepted").scalar()).withColumn("skipped", counts.select("skipped").scalar())


@query(
    "S09_ingestion_counts",
    f"WITH {PROMPT_RULE} SELECT count(*) FILTER (trim(chosen) <> '') AS accepted, count(*) FILTER (trim(chosen) = '') AS skipped FROM r",
)
def s09b(spark, d):
    return ps.ingestion_counts(ps.choose_prompts(_records(spark, d)))


@query(
    "S11_prompt_export",
    f"WITH {tb.PROMPTS} SELECT prompt_id, model_version_id, output_length, generation_time_ms FROM prompts WHERE model_version_id = 'src4' AND submitted_at >= TIMESTAMP '2024-01-01 02:00:00' AND submitted_at <= TIMESTAMP '2024-01-25 00:00:00'",
)
def s11(spark, d):
    """Filtered export to JSON, read back."""
    rows = ex.export_rows("prompts", tb.prompts(spark, d), version_id="src4", date_from=datetime(2024, 1, 1, 2), date_to=datetime(2024, 1, 25))
    path = shared_dir(spark, "export")
    ex.write_export(rows, path, "json")
    return spark.read.schema("prompt_id bigint, model_version_id string, output_length bigint, generation_time_ms double").json(path)


@query(
    "S11_version_export",
    "SELECT o_orderkey AS version_id, o_custkey AS model_id, o_orderpriority AS version FROM orders WHERE o_custkey = 17",
)
def s11b(spark, d):
    """Versions of one model to CSV; a nested column becomes JSON text."""
    versions = tb.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("version_id"),
        F.col("o_custkey").alias("model_id"),
        F.struct(F.col("o_orderpriority").alias("version")).alias("metadata"),
    )
    path = shared_dir(spark, "export")
    ex.write_export(ex.export_rows("versions", versions, model_id=17), path, "csv")
    rows = spark.read.schema("version_id bigint, model_id bigint, metadata string").option("header", True).option("escape", '"').csv(path)
    return rows.select("version_id", "model_id", F.get_json_object("metadata", "$.version").alias("version"))


def _import_rows(spark, d):
    """Label rows as text records; unknown flags, missing keys and bad numbers are mixed in."""
    labels = tb.table(spark, d, "labels")
    key = F.when(F.col("doc_id") % 11 != 0, F.col("doc_id").cast("string"))
    figure = F.when(F.col("doc_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("quality").cast("string"))
    return labels.select(F.col("doc_id").alias("index"), key.alias("prompt_id"), figure.alias("entropy"))


@query(
    "S12_import_errors",
    """SELECT doc_id AS "index", concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'prompt_id: field required' END, CASE WHEN doc_id % 13 = 0 THEN 'entropy: not a valid double' END) AS error
FROM labels WHERE doc_id % 11 = 0 OR doc_id % 13 = 0""",
)
def s12(spark, d):
    return ex.error_rows(ex.validate(_import_rows(spark, d), "metrics"))


@query(
    "S12_all_or_nothing_import",
    """SELECT 'mixed' AS run, 0 AS imported, count(*) FILTER (doc_id % 11 = 0 OR doc_id % 13 = 0) AS errors, 0 AS stored, 'Import failed with ' || count(*) FILTER (doc_id % 11 = 0 OR doc_id % 13 = 0) || ' errors.' AS message FROM labels
UNION ALL SELECT 'clean', count(*) FILTER (NOT (doc_id % 11 = 0 OR doc_id % 13 = 0)), 0, count(*) FILTER (NOT (doc_id % 11 = 0 OR doc_id % 13 = 0)), '' FROM labels""",
)
def s12b(spark, d):
    """The mixed file writes nothing, the clean part of it is appended whole."""
    mixed, clean = _import_rows(spark, d), _import_rows(spark, d).where("index % 11 <> 0 and index % 13 <> 0")
    result = None
    for name, records in (("mixed", mixed), ("clean", clean)):
        path = shared_dir(spark, "import")
        imported, errors = ex.import_records(records, "metrics", path)
        stored = spark.read.parquet(path) if imported else records.limit(0)
        message = ex.failure_notification(errors).select(F.lit(name).alias("run"), "message")
        row = (
            errors.agg(F.count("*").alias("errors"))
            .withColumn("run", F.lit(name))
            .withColumn("imported", F.lit(imported).cast("long"))
            .join(stored.agg(F.count("*").alias("stored")).withColumn("run", F.lit(name)), "run")
            .join(message, "run", "left")
            .withColumn("message", F.coalesce("message", F.lit("")))
        )
        result = row if result is None else result.unionByName(row)
    return result


IMPORT_RULE = """k AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx, quality FROM labels)"""


@query(
    "S12_csv_import",
    f"""WITH {IMPORT_RULE} SELECT idx AS "index", concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'prompt_id: field required' END, CASE WHEN doc_id % 13 = 0 THEN 'entropy: not a valid double' END) AS error
FROM k WHERE doc_id % 11 = 0 OR doc_id % 13 = 0""",
)
def s12_csv(spark, d):
    """A CSV upload of several files, read and checked; errors name the record's number over all files."""
    rows = _import_rows(spark, d).repartitionByRange(4, "index").sortWithinPartitions("index")
    path = shared_dir(spark, "import-csv")
    rows.select("prompt_id", "entropy", F.lit("a, \"b\"\nc").alias("note")).write.option("header", True).option("escape", '"').csv(path)
    return ex.error_rows(ex.validate(ex.read_import_csv(spark, path), "metrics"))


@query(
    "S12_json_import",
    f"""WITH {IMPORT_RULE} SELECT idx AS "index", CASE WHEN doc_id % 17 = 0 THEN 'not a record' ELSE concat_ws('; ', CASE WHEN doc_id % 11 = 0 THEN 'prompt_id: field required' END, CASE WHEN doc_id % 13 = 0 THEN 'entropy: not a valid double' END) END AS error
FROM k WHERE doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0""",
)
def s12_json(spark, d):
    """The same as arrays of JSON records in several files; some entries are no records."""
    labels = tb.table(spark, d, "labels")
    i = F.col("doc_id")
    figure = F.when(i % 13 == 0, F.lit('"n/a"')).otherwise(F.col("quality").cast("string"))
    key = F.when(i % 11 != 0, i.cast("string")).otherwise(F.lit("null"))
    frequency = F.lit('{"a": 0.5}')
    record = F.concat(F.lit('{"prompt_id": '), key, F.lit(', "entropy": '), figure, F.lit(', "token_frequency": '), frequency, F.lit("}"))
    entry = F.when(i % 17 == 0, F.lit("[1]")).otherwise(record)
    path = _json_arrays(spark, labels, F.floor(i / 1000), ["doc_id"], entry)
    return ex.error_rows(ex.validate(ex.read_import_json(spark, path, "metrics"), "metrics"))


@query(
    "S12_json_import_stored",
    "SELECT doc_id AS prompt_id, CAST(quality AS DOUBLE) AS entropy, 0.5::DOUBLE AS share FROM labels",
)
def s12_json_stored(spark, d):
    """A clean JSON upload ends in the target table with typed columns."""
    entry = F.concat(F.lit('{"token_frequency": {"a": 0.5}, "prompt_id": '), F.col("doc_id").cast("string"), F.lit(', "entropy": '), F.col("quality").cast("string"), F.lit("}"))
    path = _json_arrays(spark, tb.table(spark, d, "labels"), F.floor(F.col("doc_id") / 1000), ["doc_id"], entry)
    target = shared_dir(spark, "imported")
    ex.import_records(ex.read_import_json(spark, path, "metrics"), "metrics", target)
    return spark.read.parquet(target).select("prompt_id", "entropy", F.try_element_at("token_frequency", F.lit("a")).alias("share"))


SNAPSHOT_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "labels"]


@query(
    "S13_snapshot_export",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, '2024-02-01 12:30:00' AS taken_at, count(*) AS n FROM {t}" for t in SNAPSHOT_TABLES),
)
def s13(spark, d):
    """Tables are written under one timestamped folder; the manifest is checked against the stored rows."""
    root = shared_dir(spark, "backup")
    folder = sn.write_snapshot({t: tb.table(spark, d, t) for t in SNAPSHOT_TABLES}, root, MOMENT)
    manifest = spark.read.schema(sn.MANIFEST).json(f"{folder}/_manifest.d").select("table_name", "taken_at", F.col("rows").alias("told"))
    stored = None
    for t in SNAPSHOT_TABLES:
        rows = spark.read.parquet(f"{folder}/{t}").agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n")
        stored = rows if stored is None else stored.unionByName(rows)
    return manifest.join(stored, "table_name").where("told = n").drop("told")


@query(
    "S15_snapshot_restore",
    """SELECT 'append' AS mode, 'nation' AS table_name, 2 * count(*) AS n FROM nation UNION ALL SELECT 'append', 'customer', 2 * count(*) FROM customer UNION ALL SELECT 'append', 'missing', 0
UNION ALL SELECT 'replace', 'nation', count(*) FROM nation UNION ALL SELECT 'replace', 'customer', count(*) FROM customer UNION ALL SELECT 'replace', 'missing', 0""",
)
def s15(spark, d):
    """Restore twice in append mode, twice in replace mode; a table missing from the snapshot is empty."""
    tables = {t: tb.table(spark, d, t) for t in ("nation", "customer")}
    folder = sn.write_snapshot(tables, shared_dir(spark, "backup"), MOMENT)
    schemas = {t: ", ".join(f"{c} {k}" for c, k in df.dtypes) for t, df in tables.items()} | {"missing": "id bigint"}
    result = None
    for mode in ("append", "replace"):
        target = shared_dir(spark, "restored")
        for _ in range(2):
            sn.restore_snapshot(spark, folder, target, schemas, replace=mode == "replace")
        for t, schema in schemas.items():
            count = spark.read.schema(schema).parquet(f"{target}/{t}").agg(F.count("*").alias("n"))
            row = count.select(F.lit(mode).alias("mode"), F.lit(t).alias("table_name"), "n")
            result = row if result is None else result.unionByName(row)
    return result


@query(
    "S16_comparison_report",
    f"WITH {CHANGES} SELECT version_1, version_2, metric, round(delta, 6) AS delta, {HIGHLIGHT} FROM changes",
)
def s16(spark, d):
    """CSV report of all change rows, read back."""
    path = shared_dir(spark, "report")
    sn.write_report(_changes(spark, d), _current(spark, d), path, "csv")
    rows = spark.read.option("header", True).schema(
        "version_2 bigint, metric string, version_1 bigint, value_1 double, value_2 double, delta double, percent_change double, highlight boolean"
    )
    frame = rows.csv(path, enforceSchema=False)
    return frame.select("version_1", "version_2", "metric", F.round("delta", 6).alias("delta"), "highlight")


@query(
    "S16_comparison_report_json",
    f"""WITH {CHANGES}, v AS (SELECT DISTINCT model_version_id AS version_1 FROM cur), p AS (SELECT version_1, version_1 + 1 AS version_2 FROM v),
m AS (SELECT model_version_id, string_agg(metric || '=' || coalesce(CAST(round(value, 4) AS VARCHAR), 'null'), ',' ORDER BY metric) AS shown, count(*) AS n FROM cur GROUP BY 1),
c AS (SELECT version_1, version_2, count(*) AS n, sum(delta) AS total FROM changes GROUP BY ALL)
SELECT version_1, version_2, coalesce(c.n, 0) AS changes, round(coalesce(total, 0), 4) AS total_delta, coalesce(m1.n, 0) AS metrics_1, coalesce(m2.n, 0) AS metrics_2
FROM p LEFT JOIN c USING (version_1, version_2) LEFT JOIN m m1 ON m1.model_version_id = version_1 LEFT JOIN m m2 ON m2.model_version_id = version_2""",
)
def s16b(spark, d):
    """JSON report of every requested pair, read back: the last version's pair has no partner and no change row."""
    path = shared_dir(spark, "report")
    metrics = _current(spark, d)
    sn.write_report(_changes(spark, d), metrics, path, "json", pairs=_pairs(metrics))
    rows = spark.read.schema(
        "version_1 bigint, version_2 bigint, changes array<struct<metric:string,delta:double>>, metrics_1 map<string,double>, metrics_2 map<string,double>"
    ).json(path)
    total = F.aggregate("changes", F.lit(0.0), lambda a, r: a + r["delta"])
    sizes = [F.size(c).cast("long").alias(c) for c in ("changes", "metrics_1", "metrics_2")]
    return rows.select("version_1", "version_2", sizes[0], F.round(total, 4).alias("total_delta"), *sizes[1:])
