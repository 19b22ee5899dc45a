import json

from eventloom.operators import nested

RECORD = {
    "original_path": "a",
    "processes": [
        {
            "processor_name": "one",
            "inputs": {"geom": [{"original_path": "g0"}, None, {"original_path": "g2"}], "x": {"original_path": "x", "processes": {"parameters": {"deep": {"er": [1, None]}}}}},
            "outputs": [None, {"name": "o", "original_size": 3}],
            "parameters": {"k.1": 2, "a b": None, "list": [], "flag": True},
        },
        None,
        {"processor_name": None},
    ],
}
EXPECTED = {
    ("process", "/processes/0", ""),
    ("process", "/processes/2", ""),
    ("input", "/processes/0/inputs/geom/0", "/processes/0"),
    ("input", "/processes/0/inputs/geom/2", "/processes/0"),
    ("input", "/processes/0/inputs/x", "/processes/0"),
    ("process", "/processes/0/inputs/x/processes/0", "/processes/0/inputs/x"),
    ("parameter", "/processes/0/inputs/x/processes/0/parameters/deep/er/0", "/processes/0/inputs/x/processes/0"),
    ("parameter", "/processes/0/inputs/x/processes/0/parameters/deep/er/1", "/processes/0/inputs/x/processes/0"),
    ("output", "/processes/0/outputs/1", "/processes/0"),
    ("parameter", "/processes/0/parameters/k.1", "/processes/0"),
    ("parameter", "/processes/0/parameters/a b", "/processes/0"),
    ("parameter", "/processes/0/parameters/flag", "/processes/0"),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "prv_id bigint, content string, kind string, name string")


def test_nodes_and_links(spark, rows):
    text = json.dumps(RECORD)
    df = frame(spark, [(1, text, "x", "y"), (1, text, "x", "y"), (2, None, None, None), (3, '{"a"', None, None), (4, "[1]", None, None), (5, "", "", ""), (6, "{}", "", "")])
    assert set(rows(nested.found_nodes(df), "kind", "node_path", "parent_path")) == EXPECTED
    assert rows(nested.found_nodes(df).groupBy().count()) == [(len(EXPECTED),)]
    assert rows(nested.unreadable(df)) == [(2, "null"), (3, "unreadable"), (4, "not an object"), (5, "unreadable")]


def test_parents_are_prefixes(spark):
    nodes = nested.with_parents(nested.shred(frame(spark, [(1, json.dumps(RECORD), None, None)]))).collect()
    by_path = {r.node_path: r for r in nodes}
    assert len({tuple(r.dewey) for r in nodes}) == len(nodes)
    for r in nodes:
        if r.kind != "file":
            parent = by_path[r.parent_path]
            assert tuple(r.dewey[: len(parent.dewey)]) == tuple(parent.dewey) == tuple(r.parent_dewey)


def test_tables(spark, rows):
    t = nested.record_tables(nested.shred(frame(spark, [(1, json.dumps(RECORD), None, None)])))
    assert rows(t["outputs"], "name", "original_size") == [("o", "3")]
    assert rows(t["files"], "original_path") == [("a",)]
    assert ("a b", "null", None) in rows(t["parameters"], "name", "value_type", "value")
    assert t["inputs"].count() == 3 and t["processes"].count() == 3


def test_deep_and_empty(spark):
    deep = {"original_path": "end"}
    for _ in range(300):
        deep = {"processes": [{"inputs": {"a": deep}}]}
    long = json.dumps({"processes": [{"parameters": {"p": "x" * 1_000_000, "bad": "\ud800"}}]})
    df = frame(spark, [(1, json.dumps(deep), None, None), (2, long, None, None)])
    assert nested.found_nodes(df).count() == 600 + 3
    assert nested.found_nodes(df.limit(0)).count() == 0


def test_schema_paths_count_exactly(spark, tmp_path):
    from eventloom.plans import records

    n = 3000
    spark.createDataFrame([(i, json.dumps({"processes": [{"processor_name": f"p{i % 700}"}]})) for i in range(n)], "prv_id bigint, content string").write.parquet(f"{tmp_path}/prv_records.parquet")
    got = {r.kind: r for r in records.p1_schema_paths(spark, str(tmp_path)).collect()}
    assert got["process"].n_nodes == got["process"].n_records == n and got["process"].n_names == 700
