"""Files whose fields drift: one consistent table, and a report of each change.

Contents load as maps from path to raw type and text. Statistics of paths and types by file tell what each
file changes against the one before in its stream; over all files they decide the type of each column, and
projecting reports every value that does not cast. Only parsing runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from eventloom.operators.nested import json_type, raw_text, read_json, valid_text
from eventloom.runtime import Stages

CHUNK = 4096  # places of a stream in one group
COLUMNS = 2000  # columns of the consistent table; rarer paths stay in a map
_VALUES = "map<string,struct<type:string,value:string>>"


def _text(value: object) -> str | None:
    """Raw text in which equal numbers are equal, however spelt."""
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**63:
        value = int(value)
    return valid_text(raw_text(value))


def _step(name: str) -> str:
    """A name as a step of a path: ~ and / are spelt ~0 and ~1."""
    return valid_text(name).replace("~", "~0").replace("/", "~1")


def _paths(value: dict, nested: bool) -> Iterator[tuple[str, dict]]:
    for name, x in value.items():
        kind = json_type(x)
        if nested and kind in ("object", "array") and x:
            inner = x if kind == "object" else {str(i): y for i, y in enumerate(x)}
            for path, leaf in _paths(inner, nested):
                yield f"{_step(name)}/{path}", leaf
        else:
            yield _step(name) if nested else valid_text(name), {"type": kind, "value": _text(x)}


def path_values(files: DataFrame, nested: bool = False) -> DataFrame:
    """file_id, script, dataset, seq, readable, fields (path -> raw type and text); one row per file.

    ``nested`` goes down to the leaves instead of stopping at the top-level fields; in its paths a slash
    within a name is spelt ~1 and a tilde ~0. Null, empty and
    unreadable contents, and those that are no JSON object, have readable = false and no fields. Repeats
    count once. Extra columns are ignored. A field that a content spells twice has its last value.
    """
    rows = files.select("file_id", "script", "dataset", F.col("seq").cast("bigint").alias("seq"), "content").distinct()
    kind = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            readable, fields = [], []
            for text in b.column(4).to_pylist():
                value = read_json(text)
                readable.append(isinstance(value, dict))
                fields.append(list(dict(_paths(value, nested)).items()) if isinstance(value, dict) else [])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(readable, pa.bool_()), pa.array(fields, kind)], names=["file_id", "script", "dataset", "seq", "readable", "fields"])

    return rows.mapInArrow(load, f"file_id bigint, script string, dataset string, seq bigint, readable boolean, fields {_VALUES}")


# --- statistics and changes ------------------------------------------------------------------------------


def file_statistics(values: DataFrame) -> DataFrame:
    """The type and raw text of each path in each file: file_id, script, dataset, seq, path, type, value."""
    return values.select("file_id", "script", "dataset", "seq", F.explode("fields").alias("path", "x")).select("file_id", "script", "dataset", "seq", "path", "x.type", "x.value")


def type_statistics(values: DataFrame) -> DataFrame:
    """path, type, n_files, first_file, last_file over ``path_values``."""
    return file_statistics(values).groupBy("path", "type").agg(F.count("*").alias("n_files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))


def _placed(values: DataFrame, chunk: int) -> DataFrame:
    """stream, n (from 1, in order of seq and file_id), file_id, fields. Places are counted within spans of seq
    first, and the spans' sizes added, so a stream of any length is spread over tasks."""
    cut = values.select(F.to_json(F.struct("script", "dataset")).alias("stream"), F.floor(F.col("seq") / chunk).alias("span"), "seq", "file_id", "fields")
    within = cut.withColumn("place", F.row_number().over(Window.partitionBy("stream", "span").orderBy("seq", "file_id")))
    sizes = cut.groupBy("stream", "span").agg(F.count("*").alias("size"))
    before = sizes.select("stream", "span", (F.sum("size").over(Window.partitionBy("stream").orderBy("span")) - F.col("size")).alias("before"))
    return within.join(before, ["stream", "span"]).select("stream", (F.col("before") + F.col("place")).alias("n"), "file_id", "fields")


def _differences(placed: DataFrame) -> DataFrame:
    """stream, n, path, before, now (structs of type and value; null where the file lacks the path) of each path
    whose presence or type differs between a file and the one before. A file's statistics meet those of
    the file before by (stream, n, path), so no stream or path is a hot key."""
    each = placed.select("stream", "n", F.explode("fields").alias("path", "x"))
    none = F.lit(None).cast("struct<type:string,value:string>")
    both = each.select("stream", "n", "path", F.col("x").alias("now"), none.alias("before")).unionByName(each.select("stream", (F.col("n") + 1).alias("n"), "path", none.alias("now"), F.col("x").alias("before")))
    pairs = both.groupBy("stream", "n", "path").agg(F.max("before").alias("before"), F.max("now").alias("now"))
    return pairs.where("n > 1 and (now is null or before is null or now.type <> before.type)")


def _known_types(retyped: DataFrame, chunk: int) -> DataFrame:
    """Fields whose null value becomes one of another type than they had before the nulls: stream, n, path.

    Between its changes a field's type stays as it is, so the change before the end of the nulls is their
    start, which tells the type before them (none for a field that came with a null). Hot fields are cut
    into spans of n: the first change of a span takes the last one of the spans before."""
    cut = retyped.where("now.type = 'null' or before.type = 'null'").select("stream", "path", "n", F.floor(F.col("n") / chunk).alias("span"), F.struct(F.col("before.type").alias("was"), F.col("now.type").alias("is")).alias("c"))
    w = Window.partitionBy("stream", "path", "span").orderBy("n")
    within = cut.withColumn("last", F.lag("c").over(w))
    ends = cut.groupBy("stream", "path", "span").agg(F.max_by("c", "n").alias("end"))
    carried = ends.select("stream", "path", "span", F.lag("end").over(Window.partitionBy("stream", "path").orderBy("span")).alias("carried"))
    known = within.join(carried, ["stream", "path", "span"]).withColumn("start", F.coalesce("last", "carried"))
    return known.where("c.was = 'null' and c.is <> 'null' and start.is = 'null' and start.was <> 'null' and start.was <> c.is").select("stream", "n", "path")


def field_changes(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """p6_found: file_id, field_name, change_kind, new_name of each change against the readable file before.

    Candidates are the differences between the path-type statistics of a file and of the file before; of
    those that go or come, equal values of one type are renames.

    Files without seq have no place in a stream and give no rows; of equal places the smaller file_id
    comes first. Null scripts and datasets are values like any other. Of several fields that could have
    been renamed into each other, names are paired in alphabetical order.
    """
    stages = Stages(files.sparkSession, "drift")
    placed = stages.write(_placed(path_values(files).where("readable and seq is not null"), chunk))
    found = stages.write(_differences(placed))
    moved = found.where("now is null or before is null").withColumn("x", F.coalesce("now", "before"))
    sides = moved.groupBy("stream", "n", F.col("x.type").alias("type"), F.col("x.value").alias("value")).agg(
        F.sort_array(F.collect_list(F.when(F.col("now").isNull(), F.col("path")))).alias("gone"), F.sort_array(F.collect_list(F.when(F.col("before").isNull(), F.col("path")))).alias("come")
    )
    both = F.when(F.col("type") != "null", F.least(F.size("gone"), F.size("come"))).otherwise(0)
    change = lambda kind, new=None: lambda f: F.struct(f.alias("field_name"), F.lit(kind).alias("change_kind"), (F.lit("") if new is None else new(f)).alias("new_name"))
    sides = sides.withColumn("m", both)
    rest = lambda side: F.slice(side, F.col("m") + 1, F.size(side))
    renamed = F.transform(F.arrays_zip(F.slice("gone", F.lit(1), F.col("m")).alias("old"), F.slice("come", F.lit(1), F.col("m")).alias("new")), lambda z: F.struct(z["old"].alias("field_name"), F.lit("renamed").alias("change_kind"), z["new"].alias("new_name")))
    changes = sides.select("stream", "n", F.inline(F.concat(renamed, F.transform(rest("gone"), change("removed")), F.transform(rest("come"), change("added")))))
    retyped = found.where("now.type <> before.type and now.type <> 'null' and before.type <> 'null'").select("stream", "n", "path").unionByName(_known_types(found.where("now is not null"), chunk))
    types = retyped.select("stream", "n", F.col("path").alias("field_name"), F.lit("type_changed").alias("change_kind"), F.lit("").alias("new_name"))
    return changes.unionByName(types).join(placed.select("stream", "n", "file_id"), ["stream", "n"]).select("file_id", "field_name", "change_kind", "new_name")


# --- one table -----------------------------------------------------------------------------------------


def column_types(statistics: DataFrame, most: int = COLUMNS) -> dict[str, str]:
    """The commonest non-null type of each path (ties: the alphabetically last; string where there is none);
    the schema of the table, one entry per column to be built: the ``most`` paths that most files have."""
    typed = F.when(F.col("type") != "null", F.col("type"))
    rows = statistics.groupBy("path").agg(F.coalesce(F.max_by(typed, F.when(typed.isNotNull(), F.struct("n_files", "type"))), F.lit("string")).alias("type"), F.sum("n_files").alias("n"))
    return dict(sorted((r["path"], r["type"]) for r in rows.orderBy(F.desc("n"), "path").limit(most).collect()))


def _column(path: str, kind: str) -> tuple[Column, Column]:
    """The typed value, and whether a value is there that does not cast."""
    x = F.col("fields").getItem(path)
    text, there = x["value"], x["type"] != "null"
    if kind == "number":
        value = F.when(x["type"].isin("number", "string"), text.try_cast("double"))
    elif kind == "boolean":
        value = F.when(x["type"].isin("boolean", "string") & F.lower(text).isin("true", "false"), F.lower(text) == "true")
    elif kind == "string":
        value = text
    else:
        value = F.when(x["type"] == kind, text)
    return value, there & value.isNull()


def consistent_table(files: DataFrame, nested: bool = False, most: int = COLUMNS) -> DataFrame:
    """All files in one table: file_id, script, dataset, seq, readable, a typed column per path, other_fields
    and failed_casts (the paths whose value has no place in its column, with type and text).

    Where names are data there may be more paths than a table can have columns: the ``most`` commonest paths
    are columns, and the values of all others are in the map other_fields (path to type and text).

    Column names keep letters, digits and underscores of the path; names that would then clash, also with
    the fixed columns or by case, get a running number. Unreadable files have null columns.
    """
    stages = Stages(files.sparkSession, "table")
    values = stages.write(path_values(files, nested))
    used = {"file_id", "script", "dataset", "seq", "readable", "other_fields", "failed_casts"}
    columns, failed = [], []
    types = column_types(type_statistics(values), most)
    for path, kind in types.items():
        base = name = re.sub(r"\W", "_", path) or "_"
        n = 2
        while name.lower() in used:
            name, n = f"{base}_{n}", n + 1
        used.add(name.lower())
        value, bad = _column(path, kind)
        columns.append(value.alias(name))
        x = F.col("fields").getItem(path)
        failed.append(F.when(bad, F.struct(F.lit(path).alias("path"), x["type"].alias("type"), x["value"].alias("value"))))
    shape = "array<struct<path:string,type:string,value:string>>"
    casts = F.filter(F.array(*failed), lambda x: x.isNotNull()) if failed else F.array()
    known = F.create_map(*(F.lit(x) for path in types for x in (path, True))) if types else F.create_map().cast("map<string,boolean>")
    others = F.map_filter("fields", lambda path, _: known[path].isNull()) if len(types) == most else F.create_map().cast(_VALUES)
    return values.select("file_id", "script", "dataset", "seq", "readable", *columns, others.alias("other_fields"), casts.cast(shape).alias("failed_casts"))


def failed_casts(table: DataFrame) -> DataFrame:
    """file_id, path, type, value of every value that the consistent table could not hold."""
    return table.select("file_id", F.inline("failed_casts"))
