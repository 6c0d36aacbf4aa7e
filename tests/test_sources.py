import os

import pytest
from pyspark.sql import functions as F

from plumbline.durable import materialise, shared_dir
from plumbline.model import AUDIT, ROW_ID, DatasetMeta
from plumbline.sources import files, grown, publish, sinks, tables
from plumbline.sources.profile import profile
from plumbline.sources.rowid import fold_nan, with_row_id
from tests.helpers import frame

CSV = """vendor_id,vendor_name,zip,spend,active
V-1,"Acme, ""The"" Co",07001,1500.5,true
V-2,NA,62701,,false
V-3,,N/A,2,null
"""


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "vendors.csv"
    path.write_text(CSV)
    return str(path)


def test_csv_types_and_missing_tokens(spark, csv):
    got = files.ingest_file(spark, csv, text_columns=["zip"])
    assert got.success and got.meta.row_count == 3 and got.meta.column_count == 5
    assert got.meta.output_filename.startswith("vendors_clean_") and got.meta.output_filename.endswith(".csv")
    assert dict(got.table.dtypes) == {
        ROW_ID: "bigint", "vendor_id": "string", "vendor_name": "string", "zip": "string", "spend": "double", "active": "boolean",
    }
    rows = [tuple(r) for r in got.table.orderBy(ROW_ID).collect()]
    assert rows == [
        (0, "V-1", 'Acme, "The" Co', "07001", 1500.5, True),
        (1, "V-2", None, "62701", None, False),
        (2, "V-3", None, None, 2.0, None),
    ]


def test_csv_with_a_schema(spark, csv):
    df = files.read_csv(spark, csv, "vendor_id string, spend int")
    assert [tuple(r) for r in df.collect()][2] == ("V-3", 2)


@pytest.mark.parametrize("path,word", [("/no/such.csv", "not found"), ("/x/a.pdf", "Unsupported")])
def test_bad_files_are_results(spark, path, word):
    got = files.ingest_file(spark, path)
    assert not got.success and word in got.error


def test_row_limit(spark, csv):
    assert "maximum of 2" in files.ingest_file(spark, csv, max_rows=2).error
    assert files.ingest_file(spark, csv, max_rows=3).success


def test_row_ids_follow_the_scan(spark):
    df = spark.range(0, 1000, 1, 7).withColumnRenamed("id", "v")
    assert with_row_id(df).where(f"{ROW_ID} <> v").count() == 0
    assert with_row_id(df, "v").columns == [ROW_ID, "v"]


def test_nan_is_missing(spark):
    assert fold_nan(spark.createDataFrame([(float("nan"),)], "v double")).first().v is None


def test_profile(spark):
    df = frame(spark, "a string, b double", [("x", 1.0), (None, 2.0), ("y", 2.0), ("x", 3.0)])
    got = {r.column: r for r in profile(df).collect()}
    assert (got["a"].nulls, got["a"].nullable, got["a"].unique_count, got["a"].sample_values) == (1, True, 2, ["x", "y", "x"])
    assert (got["b"].dtype, got["b"].unique_count, got["b"].rows) == ("double", 3, 4)
    rough = {r.column: r.unique_count for r in profile(df, approximate=True).collect()}
    assert rough == {"a": 2, "b": 3}


@pytest.mark.parametrize("name,ok", [("schema.table", True), ("vendors_2", True), ("vendors; DROP TABLE x", False), ("vendor-master", False), ("vendor master", False), ("", False), ("t\n", False)])
def test_identifiers(name, ok):
    assert tables.is_safe_identifier(name) is ok


def test_connection_strings_lose_their_secrets():
    url = "jdbc:postgresql://ann:s3cret@db.example:5432/shop"
    assert tables.provenance(url) == {"dialect": "postgresql", "host": "db.example", "database": "shop"}
    assert "s3cret" not in tables.scrub(f"cannot reach {url}", url)
    keyed = "jdbc:mysql://h/d?user=ann&password=pw1"
    assert "pw1" not in tables.scrub(f"bad {keyed}", keyed)


def test_jdbc_options():
    split = {"partitionColumn": "id", "lowerBound": 0, "upperBound": 9, "numPartitions": 4}
    assert tables.read_options("vendors") == {"dbtable": "vendors"}
    assert tables.read_options(" select 1") == {"query": " select 1"}
    assert tables.read_options("select 1 AS id", split)["dbtable"] == "(select 1 AS id) plumbline_query"
    assert tables.read_options("vendors", split)["numPartitions"] == "4"
    with pytest.raises(ValueError):
        tables.read_options("vendors", {"nope": 1})


def test_catalog_tables_and_queries(spark):
    spark.range(1, 11).select("id", (F.col("id") * 500.0).alias("amount")).write.mode("overwrite").saveAsTable("src_vendors")
    got = tables.ingest_table(spark, tables.CATALOG, "src_vendors", key="id")
    assert got.success and got.meta.row_count == 10 and got.meta.source_table == "src_vendors"
    assert got.meta.output_table.startswith("src_vendors_clean_")
    some = tables.ingest_table(spark, tables.CATALOG, "SELECT * FROM src_vendors WHERE amount > 2500", key="id")
    assert some.meta.row_count == 5 and some.meta.output_table.startswith("query_clean_")
    assert "Invalid table name" in tables.ingest_table(spark, tables.CATALOG, "a; drop").error
    assert "Database read failed" in tables.ingest_table(spark, tables.CATALOG, "absent_table").error

    meta = got.meta
    out = sinks.export_table(got.table, meta, tables.CATALOG, "src_clean")
    assert out.success and out.row_count == 10 and out.meta.export_ready
    assert spark.table("src_clean").columns == ["id", "amount"]
    again = sinks.export_table(got.table, meta, tables.CATALOG, "src_clean")
    assert not again.success and "write failed" in again.error
    assert sinks.export_table(got.table, meta, tables.CATALOG, "src_clean", "replace").success
    for bad in (
        sinks.export_table(got.table, meta, tables.CATALOG, "src_clean", "append"),
        sinks.export_table(got.table, meta, tables.CATALOG, "bad-name"),
        sinks.export_table(got.table, meta, tables.CATALOG, "src_vendors", "replace"),
        sinks.export_table(got.table, out.meta, tables.CATALOG, "src_other"),
        sinks.export_file(got.table, meta, "/tmp/none"),
    ):
        entry = bad.audit.first()
        assert not bad.success and bad.error and not entry.success and entry.issue_id == "EXPORT"


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_file_sink(spark, tmp_path, kind):
    df = frame(spark, "vendor_id string, note string", [("V-1", 'a,"b"\nc'), ("V-2", None), ("V-3", "z")])
    meta = DatasetMeta(file_format=kind, output_filename=f"out.{kind}")
    done = sinks.export_file(df, meta, str(tmp_path), actor="ann")
    assert done.success and done.row_count == 3 and done.meta.export_ready and not meta.export_ready
    entry = done.audit.first()
    assert (entry.action_type, entry.actor, entry.affected_row_count) == ("EXPORT_FILE", "ann", 3)
    assert "already exists" in sinks.export_file(df, meta, str(tmp_path)).error
    assert "already been exported" in sinks.export_file(df, done.meta, str(tmp_path), "b").error
    wrong = DatasetMeta(source_type="DATABASE")
    assert "FILE sources only" in sinks.export_file(df, wrong, str(tmp_path)).error


def test_audit_sinks(spark, tmp_path):
    df = frame(spark, "a string", [("x",)])
    audit = sinks.export_file(df, DatasetMeta(), str(tmp_path), "f.csv").audit
    sinks.write_audit_csv(audit, str(tmp_path / "audit"))
    back = spark.read.option("header", True).csv(str(tmp_path / "audit"))
    assert tuple(back.columns) == sinks.AUDIT_CSV_FIELDS
    sinks.append_audit(audit, "audit_table")
    sinks.append_audit(audit, "audit_table")
    assert spark.table("audit_table").count() == 2


def test_a_failing_write_leaves_nothing(spark, tmp_path):
    df = frame(spark, "a string", [("x",), ("y",)]).withColumn("b", F.expr("if(a = 'y', raise_error('boom'), a)"))
    done = sinks.export_file(df, DatasetMeta(), str(tmp_path), "f.csv")
    assert not done.success and "boom" in done.error and not done.audit.first().success
    assert list(tmp_path.iterdir()) == [] and sinks.recover_exports(spark, str(tmp_path)).count() == 0


class Killed(BaseException):
    pass


@pytest.mark.parametrize("published", [False, True])
def test_a_killed_export_has_one_entry(spark, tmp_path, monkeypatch, published):
    df, meta = frame(spark, "a string", [("x",), ("y",)]), DatasetMeta()
    step = "delete" if published else "rename"

    def die(self, *args):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(publish.Folder, "delete", die)
        m.setattr(publish.Folder, step, die)
        with pytest.raises(Killed):
            sinks.export_file(df, meta, str(tmp_path), "f.csv", actor="ann")
    assert (tmp_path / "f.csv").exists() == published
    assert not published or spark.read.option("header", True).csv(str(tmp_path / "f.csv")).count() == 2
    table = f"audit_{published}"
    found = sinks.recover_exports(spark, str(tmp_path)).collect()
    sinks.record_audit(spark.createDataFrame(found, AUDIT), table)
    sinks.record_audit(spark.createDataFrame(found, AUDIT), table)
    entry = spark.table(table).collect()
    assert len(entry) == 1 and entry[0].success == published and entry[0].affected_row_count == (2 if published else 0)
    assert (entry[0].dataset_id, entry[0].actor, entry[0].issue_id) == (meta.dataset_id, "ann", "EXPORT")
    assert [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []
    assert sinks.recover_exports(spark, str(tmp_path)).count() == 0


def test_two_exports_of_one_name(spark, tmp_path, monkeypatch):
    df = frame(spark, "a string", [("x",)])
    first = sinks.export_file(df, DatasetMeta(), str(tmp_path), "f.csv")
    monkeypatch.setattr(sinks, "_exists", lambda *a: False)  # as if the other one came in between
    second = sinks.export_file(df, DatasetMeta(), str(tmp_path), "f.csv")
    assert first.success and not second.success and "already exists" in second.error
    assert spark.read.option("header", True).csv(str(tmp_path / "f.csv")).count() == 1


def test_written_tables_live_in_the_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    kept = materialise(spark.range(3), "three")
    assert kept.count() == 3 and shared_dir(spark) in kept.inputFiles()[0]


# --- profiles of folders that grow -------------------------------------------------------


def grown_profile(spark, folder, store):
    got = grown.profile_grown(spark, str(folder), str(store))
    return {r.column: (r.rows, r.nulls, r.unique_count) for r in got.columns.collect()}, {
        os.path.basename(r.path) for r in got.read.collect()
    }


def parts_of(folder):
    return {f for _, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_a_grown_folder_reads_new_files_only(spark, tmp_path):
    folder, store = tmp_path / "data", tmp_path / "store"
    low = spark.range(0, 1000, 1, 2).select("id", F.expr("if(id % 4 = 0, null, concat('v', id % 50))").alias("v"))
    low.write.parquet(str(folder))
    old = parts_of(folder)
    assert grown_profile(spark, folder, store) == ({"id": (1000, 0, pytest.approx(1000, rel=0.06)), "v": (1000, 250, 50)}, old)
    assert grown_profile(spark, folder, store)[1] == set()
    # Old files lose their contents but neither length nor date: reading one would fail.
    for name in old:
        path = folder / name
        seen = os.stat(path)
        path.write_bytes(b"x" * seen.st_size)
        os.utime(path, ns=(seen.st_atime_ns, seen.st_mtime_ns))
        (folder / f".{name}.crc").unlink(missing_ok=True)
    more = spark.range(500, 3000, 1, 3).select("id", F.concat(F.lit("v"), F.col("id") % 80).alias("v"), F.lit(1.5).alias("w"))
    more.write.mode("append").parquet(str(folder))
    columns, read = grown_profile(spark, folder, store)
    assert read == parts_of(folder) - old
    assert columns["v"] == (3500, 250, 80) and columns["w"] == (3500, 1000, 1)
    assert columns["id"] == (3500, 0, pytest.approx(3000, rel=3 * grown.RELATIVE_ERROR))


def test_changed_and_lost_files_end_their_batch(spark, tmp_path):
    folder, store = tmp_path / "data", tmp_path / "store"
    for k in range(2):
        spark.range(100 * k, 100 * k + 100, 1, 2).write.mode("append").parquet(str(folder))
        first = parts_of(folder) if k == 0 else first
        grown_profile(spark, folder, store)
    gone = sorted(first)[0]
    (folder / gone).unlink()
    columns, read = grown_profile(spark, folder, store)
    assert read == first - {gone} and columns["id"][0] == 150
    for name in first - {gone}:
        (folder / name).unlink()
    columns, read = grown_profile(spark, folder, store)
    assert read == set() and columns["id"][0] == 100
    assert columns["id"][2] == pytest.approx(100, rel=3 * grown.RELATIVE_ERROR)


def test_profiles_of_two_runs_in_one_plan(spark, tmp_path):
    folder, store = str(tmp_path / "data"), str(tmp_path / "store")
    seen = []
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(folder)
        seen.append(grown.profile_grown(spark, folder, store).columns.select(F.lit(k).alias("run"), "rows", "unique_count"))
    rows = seen[0].union(seen[1]).union(seen[2]).orderBy("run").collect()
    assert [tuple(r) for r in rows] == [(0, 10, 10), (1, 20, 20), (2, 30, 30)]


def test_an_empty_folder_has_no_columns(spark, tmp_path):
    (tmp_path / "data").mkdir()
    assert grown_profile(spark, tmp_path / "data", tmp_path / "store") == ({}, set())


def test_a_dead_run_leaves_the_profile_as_it_was(spark, tmp_path):
    folder, store = tmp_path / "data", tmp_path / "store"
    spark.range(10).write.parquet(str(folder))
    # Sketches without a list of files: the run died before its last step.
    orphan = grown.column_sketches(spark.range(7)).select(F.lit("dead").alias("batch"), "*")
    orphan.write.parquet(str(store / "sketches" / "dead"))
    assert grown_profile(spark, folder, store)[0]["id"] == (10, 0, 10)


def test_sketches_stay_within_their_error(spark):
    """Batches that overlap, of three sizes; an exact count beside each."""
    for n in (100, 10_000, 300_000):
        parts = [grown.column_sketches(spark.range(a, a + n // 2).select(F.col("id").cast("string").alias("c"))) for a in (0, n // 4, n // 2)]
        all_parts = [p.select(F.lit(str(i)).alias("batch"), "*") for i, p in enumerate(parts)]
        (row,) = grown.merged(all_parts[0].union(all_parts[1]).union(all_parts[2])).collect()
        assert row.rows == 3 * (n // 2) and row.unique_count == pytest.approx(n, rel=3 * grown.RELATIVE_ERROR)
