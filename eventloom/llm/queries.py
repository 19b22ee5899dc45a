"""Queries of the training-data problems, with SQL where SQL can state them on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import clusters, components, nearest, packing, subjects, tokens
from eventloom.runtime import Stages, table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.next_members(table(spark, folder, "clips"))


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.describe(table(spark, folder, "clips"), table(spark, folder, "cluster_results"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return components.label_groups(table(spark, folder, "cluster_pairs"), table(spark, folder, "merge_groups"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest_firings(table(spark, folder, "firings"), table(spark, folder, "detail_firings"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_ids(table(spark, folder, "documents"))


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and whether decoding gives the stored text again (empty for null)."""
    docs = table(spark, folder, "documents")
    back = tokens.decode(tokens.token_ids(docs)).withColumnRenamed("text", "decoded")
    return docs.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p7_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.token_offsets(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(tokens.token_counts(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    found = subjects.document_subjects(*(table(spark, folder, t) for t in ("documents", "subject_labels", "subjects")))
    return found.select("doc_id", "subject")


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels, names = (table(spark, folder, t) for t in ("documents", "subject_labels", "subjects"))
    found = Stages(spark, "composition").write(subjects.document_subjects(docs, labels, names))
    return subjects.composition(found, docs, names)


QUERIES = {
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p7_offsets": p7_offsets,
    "p8_containers": p8_containers,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

SQL: dict[str, str] = {
    "p4_found": """
        WITH RECURSIVE sets AS (SELECT DISTINCT list_sort(list_distinct([x FOR x IN members IF x IS NOT NULL AND x <> 0])) AS m FROM merge_groups),
        pairs AS (SELECT DISTINCT coalesce(nullif(m_k1, 0), nullif(m_k2, 0)) AS a, coalesce(nullif(m_k2, 0), nullif(m_k1, 0)) AS b FROM cluster_pairs
          UNION SELECT m[1], unnest(m) FROM sets WHERE len(m) > 0),
        edges AS (SELECT a, b FROM pairs WHERE a IS NOT NULL UNION SELECT b, a FROM pairs WHERE a IS NOT NULL),
        near AS (SELECT a AS label, least(min(b), a) AS least FROM edges GROUP BY a),
        reach AS (SELECT label, least FROM near UNION SELECT e.a, r.least FROM reach r JOIN edges e ON e.b = r.label WHERE r.least < (SELECT n.least FROM near n WHERE n.label = e.a))
        SELECT min(least) AS group_id, label FROM reach GROUP BY label
    """,
    "p5_found": """
        WITH a AS (SELECT DISTINCT event_id, recording_id, channel, time FROM firings WHERE time IS NOT NULL),
        b AS (SELECT DISTINCT event_id, recording_id, channel, time FROM detail_firings WHERE time IS NOT NULL)
        SELECT a.event_id AS event_id_a, arg_min(b.event_id, {'d': abs(a.time - b.time), 't': b.time, 'i': b.event_id}) AS event_id_b
        FROM a JOIN b ON a.recording_id = b.recording_id AND a.channel = b.channel AND abs(a.time - b.time) <= 20
        GROUP BY a.event_id
    """,
    "p7_round_trip": "SELECT doc_id, TRUE AS same FROM documents",
}
