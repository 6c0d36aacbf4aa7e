"""Registered queries on awkward inputs: large sets, nested columns, misfits, text in CSV; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.durable import shared_dir
from plumbline.model import ROW_ID, DatasetMeta, as_issues
from plumbline.operators import reference
from plumbline.plans import cleanse, scorecard
from plumbline.sources.files import read_csv
from plumbline.sources.sinks import export_file, export_table
from plumbline.sources.tables import CATALOG, ingest_table

INSTANT = "2024-06-01 12:00:00"
NO_VALUES = "issue_id string, column string, value string"


def _table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _run(df, issues, rows, values=None):
    """Apply approved issues given as (id, action, column, value, declared rows, type)."""
    spark = df.sparkSession
    schema = "issue_id string, action_type string, target_column string, canonical_value string, affected_row_count long, target_dtype string"
    base = spark.createDataFrame(issues, schema).withColumns({"status": F.lit("APPROVED"), "dataset_id": F.lit("ds")})
    seq = spark.createDataFrame([(i[0], n) for n, i in enumerate(issues)], "issue_id string, seq long")
    planned = as_issues(base).join(F.broadcast(seq), "issue_id")
    values = spark.createDataFrame(values or [], NO_VALUES)
    return cleanse.execute_approved(df, planned, rows, values, "bob", "analyst", at=F.lit(INSTANT).cast("timestamp"))


def _rows(df, *parts):
    """issue_rows from (issue, role, condition on the row id)."""
    out = None
    for issue, role, condition in parts:
        part = df.where(condition).select(
            F.lit(issue).alias("issue_id"), F.col(ROW_ID).alias("row_id"), F.lit(role).alias("role")
        )
        out = part if out is None else out.unionByName(part)
    return out


def _merge_chain(spark, folder, policy):
    """One merge per customer: it keeps the customer and retires the next of the nation.

    The 20th of a nation retires the one after next too. Nothing stops a chain from being as
    long as the nation.
    """
    df = _table(spark, folder, "customer").withColumn(ROW_ID, F.col("c_custkey"))
    nation = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    links = df.select(
        F.col("c_custkey").alias("keep"), F.lead("c_custkey", 1).over(nation).alias("next"),
        F.when(F.row_number().over(nation) == 20, F.lead("c_custkey", 2).over(nation)).alias("after"),
    ).where("next IS NOT NULL")
    issue = F.format_string("m%012d", "keep").alias("issue_id")
    base = links.select(
        issue, F.lit("MERGE_ROWS").alias("action_type"), F.lit("c_mktsegment").alias("target_column"),
        F.concat(F.lit("merged "), "keep").alias("canonical_value"), F.lit("APPROVED").alias("status"), F.lit("ds").alias("dataset_id"),
    )
    roles = F.array_compact(
        F.array(
            F.struct(F.col("keep").alias("row_id"), F.lit("retain").alias("role")),
            F.struct(F.col("next").alias("row_id"), F.lit("retire").alias("role")),
            F.when(F.col("after").isNotNull(), F.struct(F.col("after").alias("row_id"), F.lit("retire").alias("role"))),
        )
    )
    rows = links.select(issue, F.explode(roles).alias("r")).select("issue_id", "r.row_id", "r.role")
    return cleanse.execute_approved(
        df, as_issues(base), rows, spark.createDataFrame([], NO_VALUES), "bob", "analyst",
        at=F.lit(INSTANT).cast("timestamp"), merge_policy=policy,
    )


def merge_chain_sequential(spark, folder):
    return _merge_chain(spark, folder, "sequential").results.select("issue_id", "success", "rows_affected")


def merge_chain_sequential_rows(spark, folder):
    return _merge_chain(spark, folder, "sequential").table.select("c_custkey", "c_mktsegment")


def merge_chain_components(spark, folder):
    return _merge_chain(spark, folder, "components").results.select("issue_id", "success", "rows_affected")


def merge_chain_components_rows(spark, folder):
    return _merge_chain(spark, folder, "components").table.select("c_custkey", "c_mktsegment")


def ref_large_set(spark, folder):
    """Over a thousand whole numbers as the reference of a column of doubles."""
    lines = _table(spark, folder, "lineitem").withColumn(ROW_ID, F.col("l_orderkey"))
    known = {v for v in range(2000) if v % 7}
    return reference.bad_values(lines, "l_quantity", known).select("value", "n")


def cleanse_counts(spark, folder):
    """One issue declares no row count, the other far too many; both are applied."""
    df = _table(spark, folder, "customer").withColumn(ROW_ID, F.col("c_custkey"))
    issues = [
        ("none", "SET_VALUE", "c_mktsegment", "OTHER", None, None),
        ("huge", "SET_VALUE", "c_acctbal", "7.5", 2_000_000, None),
    ]
    rows = _rows(df, ("none", "target", "c_custkey % 6 = 0"), ("huge", "target", "c_custkey % 9 = 0"))
    return _run(df, issues, rows).table.select("c_custkey", "c_mktsegment", "c_acctbal")


def cleanse_nested(spark, folder):
    """Fixes on a table that has an array column."""
    df = _table(spark, folder, "embeddings").withColumn(ROW_ID, F.col("vec_id"))
    issues = [
        ("set", "SET_VALUE", "label", "99", 1, None),
        ("merge", "MERGE_ROWS", None, None, 1, None),
        ("array", "SET_VALUE", "embedding", "[1]", 1, None),
    ]
    rows = _rows(
        df,
        ("set", "target", "vec_id % 5 = 0"),
        ("merge", "retain", "vec_id = 1"),
        ("merge", "retire", "vec_id % 50 = 3"),
        ("array", "target", "vec_id % 5 = 1"),
    )
    done = _run(df, issues, rows, [("merge", "label", "77"), ("merge", "embedding", "[0.5]")])
    return done.table.select("vec_id", "label", F.size("embedding").alias("dims"), F.get("embedding", F.lit(0)).alias("first"))


def merge_misfit(spark, folder):
    """A merge whose value does not fit fails and changes nothing; one that fits runs."""
    df = _table(spark, folder, "customer").withColumn(ROW_ID, F.col("c_custkey"))
    issues = [
        ("scalar", "MERGE_ROWS", "c_acctbal", "unknown", 2, None),
        ("record", "MERGE_ROWS", None, None, 2, None),
        ("fits", "MERGE_ROWS", "c_acctbal", "12.5", 2, None),
    ]
    rows = _rows(
        df,
        ("scalar", "retain", "c_custkey = 1"), ("scalar", "retire", "c_custkey % 10 = 2"),
        ("record", "retain", "c_custkey = 3"), ("record", "retire", "c_custkey % 10 = 4"),
        ("fits", "retain", "c_custkey = 5"), ("fits", "retire", "c_custkey % 10 = 6"),
    )
    done = _run(df, issues, rows, [("record", "c_nationkey", "far away"), ("record", "c_name", "Someone")])
    verdicts = done.results.groupBy().pivot("issue_id", ["scalar", "record", "fits"]).agg(F.first("success"))
    return done.table.select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("one")).join(
        F.broadcast(verdicts.withColumn("one", F.lit(1))), "one"
    ).drop("one")


def retype_audit(spark, folder):
    """What the audit says of retyped cells is what the table holds."""
    orders = _table(spark, folder, "orders")
    df = orders.select(
        F.col("o_orderkey").alias(ROW_ID),
        F.date_format("o_orderdate", "M/d/yyyy").alias("day"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("customer"),
        F.col("o_orderpriority").alias("priority"),
    )
    issues = [
        ("day", "RETYPE_COLUMN", "day", None, 0, "datetime64[ns]"),
        ("customer", "RETYPE_COLUMN", "customer", None, 0, "int64"),
        ("priority", "RETYPE_COLUMN", "priority", None, 0, "float64"),
    ]
    done = _run(df, issues, _rows(df, ("none", "target", "false")))
    told = done.audit_cells.where("row_id is not null").select("column", "row_id", "before", "after")
    cells = F.inline(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("held")) for c in ("day", "customer", "priority")])
    )
    held = done.table.select(F.col(ROW_ID).alias("row_id"), cells)
    return told.join(held, ["column", "row_id"])


def csv_text_roundtrip(spark, folder):
    """Line breaks, quotes, outer blanks and nulls through a CSV export and back."""
    text = F.expr(
        "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN concat('  \"', text, '\", x\\n ') "
        "WHEN doc_id % 3 = 0 THEN concat(text, '\\n\\n', lang, ' ') ELSE text END"
    )
    df = _table(spark, folder, "documents").select(F.col("doc_id").alias(ROW_ID), "doc_id", text.alias("text"))
    meta = DatasetMeta(file_format="csv")
    done = export_file(df, meta, shared_dir(spark), f"texts-{uuid.uuid4().hex}.csv")
    back = read_csv(spark, done.destination, "doc_id long, text string")
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.lit(done.row_count).cast("long").alias("rows"))


def catalog_tables(spark, folder):
    """A table and a query of the session catalog are read, exported and refused like any other."""
    name = f"customers_{uuid.uuid4().hex}"
    _table(spark, folder, "customer").write.saveAsTable(name)
    whole = ingest_table(spark, CATALOG, name, key="c_custkey")
    part = ingest_table(spark, CATALOG, f"SELECT * FROM {name} WHERE c_acctbal > 0", key="c_custkey")
    done = export_table(part.table, part.meta, CATALOG, f"{name}_clean")
    again = export_table(part.table, done.meta, CATALOG, f"{name}_more")
    taken = export_table(whole.table, whole.meta, CATALOG, f"{name}_clean")
    return spark.table(f"{name}_clean").select(
        "c_custkey", "c_name", "c_acctbal",
        F.lit(whole.meta.row_count).cast("long").alias("read"),
        F.lit(done.row_count).cast("long").alias("exported"),
        F.lit(again.success).alias("again"), F.lit(taken.success).alias("taken"),
    )


def cleanse_writeback(spark, folder):
    """One issue per nation; only the approved ones run, and the registry says so."""
    df = _table(spark, folder, "customer").withColumn(ROW_ID, F.col("c_custkey"))
    per_nation = df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("affected_row_count"))
    status = F.element_at(
        F.array(*map(F.lit, ("APPROVED", "OPEN", "REJECTED", "EXECUTED", "PENDING_APPROVAL"))),
        F.pmod("c_nationkey", F.lit(5)) + 1,
    )
    issues = as_issues(
        per_nation.select(
            F.concat(F.lit("n"), "c_nationkey").alias("issue_id"), F.lit("ds").alias("dataset_id"),
            F.lit("SET_VALUE").alias("action_type"), F.lit("c_acctbal").alias("target_column"),
            F.lit("1").alias("canonical_value"), status.alias("status"), "affected_row_count",
        )
    )
    rows = df.select(
        F.concat(F.lit("n"), "c_nationkey").alias("issue_id"), F.col(ROW_ID).alias("row_id"), F.lit("target").alias("role")
    )
    only = [f"n{k}" for k in range(0, 25, 2)]
    values = spark.createDataFrame([], NO_VALUES)
    done = cleanse.execute_approved(df, issues, rows, values, "bob", only=only, at=F.lit(INSTANT).cast("timestamp"))
    told = done.results.select("issue_id", "success", "rows_affected")
    return done.issues.select("issue_id", "status", F.col("executed_at").isNotNull().alias("stamped")).join(
        told, "issue_id", "left"
    )


def score_text(spark, folder):
    """What the scorecard says about the share of late lines of every order."""
    lines = _table(spark, folder, "lineitem")
    per = lines.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("bad")
    )
    score = 100 - 100.0 * F.col("bad") / F.col("total")
    return per.select("l_orderkey", scorecard.interpretation(score, F.col("bad"), F.col("total")).alias("text"))


QUERIES = {
    f.__name__: f
    for f in (catalog_tables, cleanse_writeback, score_text, ref_large_set, cleanse_counts, cleanse_nested, merge_misfit, retype_audit, csv_text_roundtrip,
              merge_chain_sequential, merge_chain_sequential_rows, merge_chain_components, merge_chain_components_rows)
}

_CHAIN = """WITH RECURSIVE c AS (
  SELECT c_nationkey AS nation, c_custkey AS keep, c_mktsegment AS segment, row_number() OVER w AS p, count(*) OVER (PARTITION BY c_nationkey) AS n
  FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)
), run AS (
  SELECT nation, 1::BIGINT AS p, n, true AS ok, false AS ok_before FROM c WHERE p = 1
  UNION ALL
  SELECT nation, p + 1, n, NOT (ok OR (p = 21 AND ok_before)), ok FROM run WHERE p + 1 < n
), touched AS (  -- which merge names which row, both by place
  SELECT nation, p AS merge, p AS row FROM c WHERE p < n UNION ALL SELECT nation, p, p + 1 FROM c WHERE p < n
  UNION ALL SELECT nation, 20, 22 FROM c WHERE p = 20 AND n >= 22
), first AS (
  SELECT nation, row, min(merge) AS merge FROM touched WHERE row > 1 GROUP BY nation, row
)"""

ORACLES = {
    "merge_chain_sequential": f"""{_CHAIN}
        SELECT format('m{{:012d}}', keep) AS issue_id, ok AS success,
          CASE WHEN ok THEN 2 + CASE WHEN p = 20 AND c.n >= 22 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS rows_affected
        FROM run JOIN c USING (nation, p) WHERE p < c.n""",
    "merge_chain_sequential_rows": f"""{_CHAIN}, gone AS (
          SELECT nation, row AS p FROM touched t JOIN run r USING (nation) WHERE r.p = t.merge AND ok AND row <> merge)
        SELECT keep AS c_custkey, CASE WHEN ok AND p < c.n THEN 'merged ' || keep ELSE segment END AS c_mktsegment
        FROM c LEFT JOIN run USING (nation, p) ANTI JOIN gone USING (nation, p)""",
    "merge_chain_components": f"""{_CHAIN}
        SELECT format('m{{:012d}}', keep) AS issue_id, true AS success,
          1 + (SELECT count(*) FROM first f WHERE f.nation = c.nation AND f.merge = c.p) AS rows_affected
        FROM c WHERE p < n""",
    "merge_chain_components_rows": f"""{_CHAIN}
        SELECT a.keep AS c_custkey, CASE WHEN a.n > 1 THEN 'merged ' || z.keep ELSE a.segment END AS c_mktsegment
        FROM c a JOIN c z ON z.nation = a.nation AND z.p = greatest(a.n - 1, 1) WHERE a.p = 1""",
    "catalog_tables": """
        SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS read,
               (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS exported, false AS again, false AS taken
        FROM customer WHERE c_acctbal > 0""",
    "cleanse_writeback": """
        WITH n AS (SELECT c_nationkey AS k, count(*) AS c,
            ['APPROVED', 'OPEN', 'REJECTED', 'EXECUTED', 'PENDING_APPROVAL'][c_nationkey % 5 + 1] AS s
            FROM customer GROUP BY 1)
        SELECT 'n' || k AS issue_id, CASE WHEN k % 2 = 0 AND s = 'APPROVED' THEN 'EXECUTED' ELSE s END AS status,
               k % 2 = 0 AND s = 'APPROVED' AS stamped, CASE WHEN k % 2 = 0 THEN s = 'APPROVED' END AS success,
               CASE WHEN k % 2 = 0 THEN CASE WHEN s = 'APPROVED' THEN c ELSE 0 END END AS rows_affected FROM n""",
    "score_text": """
        WITH p AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (WHERE l_returnflag = 'R') AS b FROM lineitem GROUP BY 1),
        q AS (SELECT *, 100 - 100.0 * b / t AS s, concat(b, ' row(s) (', round(b * 100 / t)::BIGINT, '%)') AS rows FROM p)
        SELECT l_orderkey, concat(round(s)::BIGINT, ' of 100 points: ') || CASE WHEN s >= 95 THEN 'safe to load' WHEN s >= 80 THEN 'loadable once someone has looked at ' || rows
                  WHEN s >= 60 THEN 'repair first; serious findings touch ' || rows
                  ELSE 'keep out of other systems; serious findings touch ' || rows END || '.' AS text FROM q""",
    "ref_large_set": """
        SELECT l_quantity AS value, count(*) AS n FROM lineitem
        WHERE l_quantity NOT IN (SELECT range FROM range(2000) WHERE range % 7 <> 0) GROUP BY 1""",
    "cleanse_counts": """
        SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'OTHER' ELSE c_mktsegment END AS c_mktsegment,
               CASE WHEN c_custkey % 9 = 0 THEN 7.5::DOUBLE ELSE c_acctbal END AS c_acctbal FROM customer""",
    "cleanse_nested": """
        SELECT vec_id, (CASE WHEN vec_id = 1 THEN 77 WHEN vec_id % 5 = 0 THEN 99 ELSE label END)::INTEGER AS label,
               len(embedding)::INTEGER AS dims, embedding[1] AS first
        FROM embeddings WHERE vec_id % 50 <> 3""",
    "merge_misfit": """
        SELECT c_custkey, c_name, CASE WHEN c_custkey = 5 THEN 12.5::DOUBLE ELSE c_acctbal END AS c_acctbal,
               false AS scalar, false AS record, true AS fits
        FROM customer WHERE c_custkey % 10 <> 6""",
    "retype_audit": """
        WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3)
        SELECT 'day' AS "column", o_orderkey AS row_id, strftime(o_orderdate, '%-m/%-d/%Y') AS before,
               strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS after, strftime(o_orderdate, '%Y-%m-%d 00:00:00') AS held FROM f
        UNION ALL SELECT 'customer', o_orderkey, o_custkey || '.0', o_custkey::VARCHAR, o_custkey::VARCHAR FROM f
        UNION ALL SELECT 'priority', o_orderkey, o_orderpriority, NULL, NULL FROM f""",
    "csv_text_roundtrip": r"""
        SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN '  "' || text || '", x' || chr(10) || ' '
               WHEN doc_id % 3 = 0 THEN text || chr(10) || chr(10) || lang || ' ' ELSE text END) AS text_sha256,
               (SELECT count(*) FROM documents) AS rows FROM documents""",
}
