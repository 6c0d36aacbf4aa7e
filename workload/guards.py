"""Registered queries on limits, names, guards and export records; and their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from plumbline.durable import shared_dir
from plumbline.model import ROW_ID, SignalConfig
from plumbline.operators import entity
from plumbline.plans import resolve
from plumbline.sources.files import ingest_file
from plumbline.sources.sinks import export_file, record_audit, recover_exports
from plumbline.sources.tables import is_safe_identifier, provenance, scrub
from workload import inputs
from workload.queries import DATASET, derived


def _union(parts):
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def row_limits(spark, folder):
    """Each table against a limit: read whole, or refused."""
    parts = []
    for name in ("customer", "orders", "lineitem", "documents"):
        found = ingest_file(spark, f"{folder}/{name}.parquet", max_rows=2000)
        rows = found.table.agg(F.count(F.lit(1)).alias("n")) if found.success else spark.range(1).select(F.lit(None).cast("long").alias("n"))
        told = found.error is not None and "maximum of 2,000 rows" in found.error
        parts.append(rows.select(F.lit(name).alias("name"), F.lit(found.success).alias("success"), "n", F.lit(told).alias("told")))
    return _union(parts)


def export_names(spark, folder):
    """What an export of a table is called by default, and what it holds."""
    home, parts = f"{shared_dir(spark)}/names-{uuid.uuid4().hex}", []
    for name in ("customer", "supplier", "part"):
        read = ingest_file(spark, f"{folder}/{name}.parquet")
        done = export_file(read.table, read.meta, home)
        shape = F.regexp_replace(F.lit(done.destination.rsplit("/", 1)[1]), r"\d{8}T\d{6}", "TIME")
        rows = spark.read.parquet(done.destination).agg(F.count(F.lit(1)).alias("n"))
        parts.append(rows.select(F.lit(name).alias("name"), shape.alias("output"), "n"))
    return _union(parts)


def export_audit(spark, folder):
    """Audit entries of an export, of a second one, of one that breaks, and of what is left of a dead one."""
    home, table = f"{shared_dir(spark)}/exports-{uuid.uuid4().hex}", f"exports_{uuid.uuid4().hex}"
    read = ingest_file(spark, f"{folder}/customer.parquet", key="c_custkey")
    done = export_file(read.table, read.meta, home, "customers.parquet", actor="first")
    again = export_file(read.table, done.meta, home, "more.parquet", actor="again")
    taken = export_file(read.table, read.meta, home, "customers.parquet", actor="taken")
    row = F.when(F.col("c_custkey") % 50 == 7, F.raise_error(F.lit("bad row"))).otherwise(F.col("c_name"))
    broken = export_file(read.table.withColumn("c_name", row), read.meta, home, "broken.parquet", actor="broken")
    for made in (done, again, taken, broken, done):
        record_audit(made.audit, table)
    record_audit(recover_exports(spark, home), table)
    kept = spark.read.parquet(done.destination).agg(F.count(F.lit(1)).alias("kept"))
    entries = spark.table(table).select("actor", "issue_id", "action_type", "success", "affected_row_count")
    return entries.crossJoin(F.broadcast(kept))


def signal_columns(spark, folder):
    """Which signal each column of the vendors is taken for, and how many cells it has."""
    df = derived(spark, folder, inputs.VENDORS)
    config = entity.auto_detect([c for c in df.columns if c != ROW_ID])
    found = [(s, c) for s in config.active() for c in config.columns(s)]
    counts = df.agg(*[F.count(F.col(c)).alias(c) for _, c in found])
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.lit(c).alias("column"), F.col(c).alias("cells")) for s, c in found])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


def er_absent_columns(spark, folder):
    """A configuration with columns that the table lacks, and one that has no others."""
    df = derived(spark, folder, inputs.SUPPLIER_VENDORS)
    config = SignalConfig(name=("no_such_name",), tax_id=("tax_id", "no_such_id"), address=("no_such_street",))
    found = resolve.resolve_entities(df, DATASET, config).clusters
    none = resolve.resolve_entities(df, DATASET, SignalConfig(name=("no_such_name",)))
    return found.select("cluster", "size", "confidence", F.lit(none.note.split(":")[0]).alias("without_columns"))


def connection_guards(spark, folder):
    """Identifiers, provenance and credentials of made-up connections, one per customer."""
    text = F.concat_ws(
        "", F.lit("jdbc:postgresql://user"), "c_custkey", F.lit(":secret"), "c_custkey", F.lit("@host"), "c_nationkey", F.lit("/db?password=pw"), "c_custkey"
    )

    def guard(batches):
        for rows in batches:
            origins = [provenance(u) for u in rows["url"]]
            yield pd.DataFrame(
                {
                    "c_custkey": rows["c_custkey"],
                    "safe": [is_safe_identifier(t) for t in rows["name"]],
                    "origin": [f"{o['dialect']}|{o['host']}|{o['database']}" for o in origins],
                    "message": [scrub(f"cannot open {u}", u) for u in rows["url"]],
                }
            )

    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat(F.lit("s."), F.lower("c_mktsegment")))
    rows = spark.read.parquet(f"{folder}/customer.parquet").select("c_custkey", name.alias("name"), text.alias("url"))
    return rows.mapInPandas(guard, "c_custkey long, safe boolean, origin string, message string")


QUERIES = {f.__name__: f for f in (row_limits, export_names, export_audit, signal_columns, er_absent_columns, connection_guards)}

_CELLS = " UNION ALL ".join(
    f"SELECT '{s}' AS signal, '{c}' AS \"column\", (SELECT count({c}) FROM t) AS cells"
    for s, c in (("name", "vendor_name"), ("address", "address"), ("tax_id", "tax_id"), ("zip", "zip"), ("phone", "phone"))
)
ORACLES = {
    "row_limits": " UNION ALL ".join(
        f"SELECT '{t}' AS name, count(*) <= 2000 AS success, CASE WHEN count(*) <= 2000 THEN count(*) END AS n, count(*) > 2000 AS told FROM {t}"
        for t in ("customer", "orders", "lineitem", "documents")
    ),
    "export_names": " UNION ALL ".join(
        f"SELECT '{t}' AS name, '{t}_clean_TIME.parquet' AS output, count(*) AS n FROM {t}" for t in ("customer", "supplier", "part")
    ),
    "export_audit": """
        WITH n AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 50 = 7) AS bad FROM customer)
        SELECT actor, 'EXPORT' AS issue_id, 'EXPORT_FILE' AS action_type, actor = 'first' OR actor = 'broken' AND bad = 0 AS success,
               CASE WHEN actor = 'first' THEN n ELSE 0 END AS affected_row_count, n AS kept
        FROM n, (SELECT unnest(['first', 'again', 'taken', 'broken']) AS actor)""",
    "signal_columns": f"WITH t AS ({inputs.VENDORS}) {_CELLS}",
    "er_absent_columns": f"""
        WITH t AS ({inputs.SUPPLIER_VENDORS}),
          k AS (SELECT _row_id, upper(regexp_replace(coalesce(tax_id, ''), '[\\s-]', '', 'g')) AS key FROM t)
        SELECT min(_row_id) AS cluster, count(*) AS size, 1.0::DOUBLE AS confidence, 'skipped' AS without_columns
        FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1""",
    "connection_guards": """
        SELECT c_custkey, regexp_full_match(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 's.' || lower(c_mktsegment) END, '[A-Za-z0-9_.]+') AS safe,
          'postgresql|host' || c_nationkey || '|db' AS origin,
          'cannot open jdbc:postgresql://***:***@host' || c_nationkey || '/db?password=***' AS message
        FROM customer""",
}
