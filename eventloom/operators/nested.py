"""Nested JSON records to related flat tables, by Dewey labels.

Every node of a record gets the list of its ancestors' ordinals (its Dewey label). A parent's label is a
prefix of its child's, so parent links need no lookups or joins: they come from truncating the label, and
the textual path alike. Nodes that share a schema path (their path without ordinals and instance names)
form one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "kind string, schema_path string, node_path string, parent_length int, dewey array<int>, parent_depth int, "
    "name string, value_type string, value string, attributes map<string,string>"
)
_ARROW = [
    ("kind", pa.string()), ("schema_path", pa.string()), ("node_path", pa.string()), ("parent_length", pa.int32()),
    ("dewey", pa.list_(pa.int32())), ("parent_depth", pa.int32()), ("name", pa.string()),
    ("value_type", pa.string()), ("value", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())),
]


def json_type(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, list) else "object"


def raw_text(value: object) -> str | None:
    """The text of a JSON value: strings as they are, the rest as compact JSON with sorted keys."""
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def valid_text(value: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can spell and UTF-8 cannot, become question marks."""
    return value if value is None or value.isascii() else value.encode("utf-8", "replace").decode("utf-8")


def read_json(text: str | None) -> object:
    """The parsed value, or ``read_json`` itself as the mark of an unreadable text."""
    if text is None:
        return read_json
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return read_json


def _scalars(fields: dict) -> list[tuple[str, str | None]]:
    return [(valid_text(k), valid_text(raw_text(v))) for k, v in fields.items() if not isinstance(v, (dict, list))]


def _children(value: object) -> Iterator[tuple[int, str, object]]:
    """(ordinal, step, child) of a container."""
    if isinstance(value, dict):
        for i, (k, v) in enumerate(value.items()):
            yield i, k, v
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield i, str(i), v


def record_nodes(record: object) -> Iterator[tuple]:
    """Nodes of one provenance record, each once, in no particular order.

    An explicit stack instead of recursion: depth is bounded by the JSON parser only.
    """
    if not isinstance(record, dict):
        return
    # work on file objects: (object, kind, schema path, path, label, owner's path length, owner's label length)
    stack = [(record, "file", "", "", [], 0, 0, None)]
    while stack:
        node, kind, schema, path, label, up_length, up_depth, name = stack.pop()
        yield kind, schema or "/", path, up_length, label, up_depth, name, "object", None, _scalars(node)
        keys = list(node)
        processes = node.get("processes")
        if isinstance(processes, dict):
            processes = [processes]
        if not isinstance(processes, list):
            continue
        at = keys.index("processes")
        for i, process in enumerate(processes):
            if not isinstance(process, dict):
                continue
            p_schema, p_path, p_label = f"{schema}/processes", f"{path}/processes/{i}", [*label, at, i]
            p_name = process.get("processor_name")
            yield "process", p_schema, p_path, len(path), p_label, len(label), raw_text(p_name), "object", None, _scalars(process)
            for ordinal, (key, value) in enumerate(process.items()):
                if key in ("inputs", "outputs"):
                    for j, step, entry in _children(value):
                        entries = [(f"{p_path}/{key}/{step}", [*p_label, ordinal, j], entry)]
                        if isinstance(entry, list):
                            entries = [(f"{entries[0][0]}/{n}", [*entries[0][1], n], x) for n, x in enumerate(entry)]
                        for e_path, e_label, x in entries:
                            if isinstance(x, dict):
                                e_name = step if isinstance(value, dict) else raw_text(x.get("name"))
                                stack.append((x, key[:-1], f"{p_schema}/{key}", e_path, e_label, len(p_path), len(p_label), e_name))
                elif key == "parameters":
                    todo = [(f"{p_path}/{key}/{step}", [*p_label, ordinal, j], x, step) for j, step, x in _children(value)]
                    while todo:
                        v_path, v_label, v, v_name = todo.pop()
                        if isinstance(v, (dict, list)):
                            todo += [(f"{v_path}/{step}", [*v_label, j], x, f"{v_name}/{step}") for j, step, x in _children(v)]
                        else:
                            yield "parameter", f"{p_schema}/parameters", v_path, len(p_path), v_label, len(p_label), v_name, json_type(v), raw_text(v), []


def shred(df: DataFrame, id_col: str = "prv_id", content_col: str = "content") -> DataFrame:
    """One row per node of each readable content: file, process, input, output and parameter nodes.

    Columns: the id and those of ``NODES``. ``dewey`` is the node's label; its first ``parent_depth``
    ordinals are the label of the parent, the first ``parent_length`` characters of ``node_path`` the
    parent's path. Null, empty and unreadable contents, and contents that are no JSON object, give no
    rows (``unreadable`` lists them). Repeated rows count once; other columns of the input are ignored,
    whatever their names. An empty table gives an empty one. The work is one pass over distinct rows;
    the only shuffle is the one that drops repeats.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("record_id"), F.col(content_col).alias("content")).where("content is not null").distinct()

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            texts = batch.column(1)
            where: list[int] = []
            out: list[tuple] = []
            for i in range(len(texts)):
                record = read_json(texts[i].as_py())
                before = len(out)
                out.extend(record_nodes(record))
                where.extend([i] * (len(out) - before))
                if len(out) >= 20_000 or i + 1 == len(texts):
                    columns = list(zip(*out)) if out else [()] * len(_ARROW)
                    arrays = [ids.take(pa.array(where, pa.int32()))]
                    for (_, kind), column in zip(_ARROW, columns):
                        values = [valid_text(x) for x in column] if kind == pa.string() else column
                        arrays.append(pa.array(values, kind))
                    yield pa.RecordBatch.from_arrays(arrays, names=["record_id", *(n for n, _ in _ARROW)])
                    where, out = [], []

    return rows.mapInArrow(nodes, f"record_id {id_type}, {NODES}").withColumnRenamed("record_id", id_col)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds parent_path and parent_dewey by truncation."""
    return nodes.withColumns(
        {
            "parent_path": F.expr("substring(node_path, 1, parent_length)"),
            "parent_dewey": F.expr("slice(dewey, 1, parent_depth)"),
        }
    )


def record_tables(nodes: DataFrame, id_col: str = "prv_id") -> dict[str, DataFrame]:
    """The flat tables: files (one row per record), processes, inputs, outputs and parameters.

    Child tables join their parent on (id, parent_path) = (id, node_path). An input or output is itself a
    file, so nested processes link to it the same way as top ones to the record.
    """
    linked = with_parents(nodes)
    key = [id_col, "node_path", "parent_path", "dewey", "parent_dewey"]
    file = {n: F.col("attributes")[n] for n in ("original_path", "original_checksum", "original_checksum_1000", "original_size", "prv_version")}

    def of(kind: str, **columns) -> DataFrame:
        return linked.where(F.col("kind") == kind).select(*key, *(c.alias(n) for n, c in columns.items()))

    return {
        "files": of("file", **file),
        "processes": of("process", processor_name=F.col("name"), processor_version=F.col("attributes")["processor_version"]),
        "inputs": of("input", name=F.col("name"), **file),
        "outputs": of("output", name=F.col("name"), **file),
        "parameters": of("parameter", name=F.col("name"), value_type=F.col("value_type"), value=F.col("value")),
    }


def found_nodes(records: DataFrame) -> DataFrame:
    """p1_found: prv_id, kind, node_path, parent_path of each process, input, output and parameter."""
    return with_parents(shred(records)).where("kind <> 'file'").select("prv_id", "kind", "node_path", "parent_path")


def unreadable(df: DataFrame, id_col: str = "prv_id", content_col: str = "content") -> DataFrame:
    """Records that ``shred`` gives no rows for, with the reason: null, unreadable or not an object."""
    id_type = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("record_id"), F.col(content_col).alias("content")).distinct()

    def reasons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            why = []
            for text in batch.column(1):
                value = read_json(text.as_py())
                why.append("null" if not text.is_valid else "unreadable" if value is read_json else None if isinstance(value, dict) else "not an object")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(why, pa.string())], names=["record_id", "reason"])

    return rows.mapInArrow(reasons, f"record_id {id_type}, reason string").where("reason is not null").withColumnRenamed("record_id", id_col)
