import json
import random

from eventloom.operators import drift
from eventloom.operators.nested import json_type


def frame(spark, rows):
    return spark.createDataFrame(rows, "file_id bigint, script string, dataset string, seq int, content string, chunk string, state string")


def stream(contents, script="s", dataset="d", start=1):
    return [(start + i, script, dataset, i + 1, c if c is None or isinstance(c, str) else json.dumps(c), "x", None) for i, c in enumerate(contents)]


def test_kinds_of_change(spark, rows):
    files = stream([{"a": 1, "b": "x"}, None, {"a": 1.0, "B": "x"}, "{broken", "[]", {"a": None, "B": "x"}, {"a": "1", "c": "x"}, {"a": 2}, {"a": 2, "c": True}])
    got = rows(drift.field_changes(frame(spark, files + files[:3])))
    assert got == [(3, "b", "renamed", "B"), (7, "B", "renamed", "c"), (7, "a", "type_changed", ""), (8, "a", "type_changed", ""), (8, "c", "removed", ""), (9, "c", "added", "")]


def brute(files):
    out, state = [], {}
    for file_id, script, dataset, seq, content, *_ in sorted(set(files), key=lambda f: (str(f[1]), str(f[2]), f[3])):
        try:
            now = json.loads(content)
        except (TypeError, ValueError):
            continue
        if not isinstance(now, dict):
            continue
        prev, known = state.get((script, dataset), (None, {}))
        new_known = {}
        if prev is not None:
            gone, come, old = sorted(set(prev) - set(now)), sorted(set(now) - set(prev)), {}
            for n in come:
                m = next((g for g in gone if prev[g] is not None and json_type(prev[g]) == json_type(now[n]) and prev[g] == now[n]), None)
                if m is None:
                    out.append((file_id, n, "added", ""))
                else:
                    gone.remove(m)
                    old[n] = m
                    out.append((file_id, m, "renamed", n))
            out += [(file_id, g, "removed", "") for g in gone]
        for n, v in now.items():
            before = known.get(old.get(n, n)) if prev is not None and (n in prev or n in old) else None
            if v is not None and before not in (None, json_type(v)):
                out.append((file_id, n, "type_changed", ""))
            new_known[n] = before if v is None else json_type(v)
        state[script, dataset] = (now, new_known)
    return sorted(out, key=repr)


def test_chunks_against_brute_force(spark, rows):
    rng = random.Random(4)
    values = [1, 1.5, "x", "y", None, True, [1], {"u": 1}]
    files, at = [], 1
    for s in range(4):
        content = {"a": 1, "b": "x"}
        contents = []
        for _ in range(40):
            content = dict(content)
            for _ in range(rng.randint(0, 3)):
                n = rng.choice("abcdef")
                if rng.random() < 0.3:
                    content.pop(n, None)
                elif rng.random() < 0.3 and content:
                    content[n] = content.pop(rng.choice(sorted(content)))
                else:
                    content[n] = rng.choice(values)
            contents.append(rng.choice([content] * 8 + [None, "bad"]))
        files += stream(contents, f"s{s % 2}" if s else None, f"d{s}", at)
        at += 100
    for chunk in (1, 3, 7, 4096):
        assert rows(drift.field_changes(frame(spark, files), chunk)) == brute(files)


def test_table_and_failed_casts(spark, rows):
    files = stream([{"a": 1, "A": "t", "file_id": 5, "x.y": 1}, {"a": "2"}, {"a": "no", "b": {"u": 1}}, {"a": None}, {"a": 3}, {"a": 4}, None])
    t = drift.consistent_table(frame(spark, files))
    assert {"A", "a_2", "file_id_2", "x_y", "b"} <= set(t.columns)
    assert rows(t, "file_id", "a_2", "readable") == [(1, 1.0, True), (2, 2.0, True), (3, None, True), (4, None, True), (5, 3.0, True), (6, 4.0, True), (7, None, False)]
    assert rows(drift.failed_casts(t)) == [(3, "a", "string", "no")]
    deep = drift.path_values(frame(spark, files), nested=True)
    assert ("b/u", "number", 1) in rows(drift.type_statistics(deep), "path", "type", "n_files")


def test_empty(spark):
    none = frame(spark, [])
    assert drift.field_changes(none).count() == 0 and drift.consistent_table(none).count() == 0


def test_steps_of_nested_paths_do_not_mix(spark, rows):
    values = drift.path_values(frame(spark, stream([{"a/b": 1, "a": {"b": 2, "~": 3}}])), nested=True)
    assert rows(drift.file_statistics(values), "path", "value") == [("a/b", "2"), ("a/~0", "3"), ("a~1b", "1")]


def test_more_paths_than_columns(spark, rows):
    files = frame(spark, stream([{"a": 1, "b": 2}, {"a": 3, "c": "x"}, {"a": 4, "b": 5}]))
    t = drift.consistent_table(files, most=2)
    assert rows(t, "file_id", "a", "b") == [(1, 1.0, 2.0), (2, 3.0, None), (3, 4.0, 5.0)]
    assert [tuple(r) for r in t.where("size(other_fields) > 0").selectExpr("file_id", "other_fields['c'].value").collect()] == [(2, "x")]
