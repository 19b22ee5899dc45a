"""Queries of the record, series and file problems that the core solves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators import drift, nested, spikes
from eventloom.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.found_nodes(table(spark, folder, "prv_records"))


def _p1(kind: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.record_tables(nested.shred(table(spark, folder, "prv_records")))[kind]

    return query


def p1_schema_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The tables by schema path: how many nodes, records and distinct names each holds, and the depth.
    Spark combines repeats of a path's records and names before the shuffle."""
    nodes = nested.shred(table(spark, folder, "prv_records"))
    return nodes.groupBy("kind", "schema_path").agg(F.count("*").alias("n_nodes"), F.count_distinct("prv_id").alias("n_records"), F.count_distinct("name").alias("n_names"), F.max(F.size("dewey")).alias("deepest"))


def p1_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    return nested.unreadable(table(spark, folder, "prv_records"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.found_readings(table(spark, folder, "timeseries"), table(spark, folder, "recordings"))


def p3_flags(spark: SparkSession, folder: str) -> DataFrame:
    return spikes.flag_readings(table(spark, folder, "timeseries"), table(spark, folder, "recordings"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.field_changes(table(spark, folder, "param_files"))


def p6_table(spark: SparkSession, folder: str) -> DataFrame:
    return drift.consistent_table(table(spark, folder, "param_files"))


def p6_failed_casts(spark: SparkSession, folder: str) -> DataFrame:
    return drift.failed_casts(drift.consistent_table(table(spark, folder, "param_files")))


def p6_type_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return drift.type_statistics(drift.path_values(table(spark, folder, "param_files")))


QUERIES = {
    "p1_found": p1_found,
    "p1_files": _p1("files"),
    "p1_processes": _p1("processes"),
    "p1_inputs": _p1("inputs"),
    "p1_outputs": _p1("outputs"),
    "p1_parameters": _p1("parameters"),
    "p1_schema_paths": p1_schema_paths,
    "p1_unreadable": p1_unreadable,
    "p3_found": p3_found,
    "p3_flags": p3_flags,
    "p6_found": p6_found,
    "p6_table": p6_table,
    "p6_failed_casts": p6_failed_casts,
    "p6_type_statistics": p6_type_statistics,
}
_KIND = "CASE json_type({x}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'number' END"
_FIELDS = f"""WITH once AS (SELECT DISTINCT file_id, script, dataset, seq, content FROM param_files),
    readable AS (SELECT * FROM once WHERE CASE WHEN json_valid(content) THEN json_type(content) = 'OBJECT' ELSE FALSE END),
    fields AS (SELECT file_id, script, dataset, seq, path, {_KIND.format(x="x")} AS type, CASE WHEN json_type(x) IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN CAST(CAST(x AS DOUBLE) AS VARCHAR) ELSE CAST(x AS VARCHAR) END AS value
      FROM (SELECT file_id, script, dataset, seq, path, json_extract(content, '$."' || path || '"') AS x FROM (SELECT *, unnest(json_keys(content)) AS path FROM readable)))"""
SQL: dict[str, str] = {
    "p1_unreadable": "SELECT prv_id, reason FROM (SELECT prv_id, CASE WHEN content IS NULL THEN 'null' WHEN NOT json_valid(content) THEN 'unreadable' WHEN json_type(content) <> 'OBJECT' THEN 'not an object' END AS reason FROM (SELECT DISTINCT prv_id, content FROM prv_records)) WHERE reason IS NOT NULL",
    "p6_type_statistics": _FIELDS + " SELECT path, type, count(*) AS n_files, min(file_id) AS first_file, max(file_id) AS last_file FROM fields GROUP BY ALL",
    "p6_failed_casts": _FIELDS
    + """, columns AS (SELECT path, coalesce(arg_max(type, {'n': n, 't': type}) FILTER (type <> 'null'), 'string') AS kind FROM (SELECT path, type, count(*) AS n FROM fields GROUP BY ALL) GROUP BY path),
    texts AS (SELECT file_id, path, x.type, CASE WHEN x.type = 'string' THEN json_extract_string(r.content, '$."' || path || '"') WHEN x.type = 'object' THEN '{' || coalesce((SELECT string_agg('"' || k || '":' || CAST(json_extract(x.value, '$."' || k || '"') AS VARCHAR), ',' ORDER BY k) FROM (SELECT unnest(json_keys(x.value)) AS k)), '') || '}' ELSE x.value END AS value FROM fields x JOIN readable r USING (file_id))
    SELECT file_id, path, type, CASE WHEN type = 'number' AND TRY_CAST(value AS DOUBLE) = floor(TRY_CAST(value AS DOUBLE)) THEN CAST(CAST(TRY_CAST(value AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE value END AS value FROM texts JOIN columns USING (path)
    WHERE type <> 'null' AND NOT CASE kind WHEN 'number' THEN type IN ('number', 'string') AND TRY_CAST(value AS DOUBLE) IS NOT NULL WHEN 'boolean' THEN type IN ('boolean', 'string') AND lower(value) IN ('true', 'false') WHEN 'string' THEN TRUE ELSE type = kind END""",
    "p6_found": _FIELDS
    + """, placed AS (SELECT *, to_json({'s': script, 'd': dataset}) AS stream, row_number() OVER (PARTITION BY script, dataset ORDER BY seq, file_id) AS n FROM readable WHERE seq IS NOT NULL),
    f AS (SELECT p.stream, p.n, p.file_id, x.path, x.type, x.value FROM placed p JOIN fields x USING (file_id)),
    gone AS (SELECT p.stream, p.n, p.file_id, f.path, f.type, f.value FROM placed p JOIN f ON f.stream = p.stream AND f.n = p.n - 1 WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.file_id = p.file_id AND g.path = f.path)),
    come AS (SELECT f.* FROM f WHERE f.n > 1 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.stream = f.stream AND g.n = f.n - 1 AND g.path = f.path)),
    a AS (SELECT *, row_number() OVER (PARTITION BY file_id, type, value ORDER BY path) AS i FROM gone), b AS (SELECT *, row_number() OVER (PARTITION BY file_id, type, value ORDER BY path) AS i FROM come),
    moved AS (SELECT coalesce(a.file_id, b.file_id) AS file_id, a.path AS old, b.path AS new FROM a FULL JOIN b ON b.file_id = a.file_id AND b.type = a.type AND b.value = a.value AND b.i = a.i AND a.type <> 'null'),
    born AS (SELECT stream, path, n FROM come), known AS (SELECT f.*, (SELECT arg_max(g.type, g.n) FROM f g WHERE g.stream = f.stream AND g.path = f.path AND g.n < f.n AND g.type <> 'null' AND g.n >= coalesce((SELECT max(h.n) FROM born h WHERE h.stream = f.stream AND h.path = f.path AND h.n <= f.n), 0)) AS before FROM f)
    SELECT file_id, coalesce(old, new) AS field_name, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' ELSE 'renamed' END AS change_kind, CASE WHEN old IS NOT NULL AND new IS NOT NULL THEN new ELSE '' END AS new_name FROM moved
    UNION ALL SELECT file_id, path, 'type_changed', '' FROM known WHERE type <> 'null' AND before IS NOT NULL AND before <> type""",
}
