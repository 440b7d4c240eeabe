"""Nested records against a plain recursion, and odd inputs."""

import json
import random

from papyra.operators import nested as N


def brute(node, path, parent):
    if isinstance(node, dict):
        for k, v in node.items():
            yield from brute(v, f"{path}.{k}", parent)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            own = f"{path}[{i}]"
            if isinstance(v, dict):
                yield own, parent
                yield from brute(v, own, own)
            else:
                yield from brute(v, own, parent)


def random_json(rng, depth):
    kind = rng.randrange(7 if depth else 4)
    if kind > 4:
        return [random_json(rng, depth - 1) for _ in range(rng.randrange(4))]
    if kind == 4:
        return {rng.choice("abcd"): random_json(rng, depth - 1) for _ in range(rng.randrange(4))}
    return [None, True, 1.5, "x[0]"][kind]


def test_objects_match_recursion():
    rng = random.Random(3)
    for _ in range(500):
        node = {"r": random_json(rng, 5)}
        text = json.dumps(node)
        want = sorted(brute(json.loads(text), "m", ""))
        assert sorted(N.objects(text, "m")) == want


def test_leaves_match_recursion():
    def leaves(node, path):
        for k, v in node.items() if isinstance(node, dict) else enumerate(node) if isinstance(node, list) else ():
            yield from leaves(v, f"{path}.{k}" if isinstance(node, dict) else f"{path}[{k}]")
        if node is not None and not isinstance(node, (dict, list)):
            yield path, json.dumps(node).strip('"')

    rng = random.Random(4)
    for _ in range(300):
        text = json.dumps({"r": random_json(rng, 5)})
        got = [(e + (f".{f}" if f and not f.startswith("[") else f), v) for _, e, _, _, f, v, k in N.triples(text, "m") if k != "object"]
        assert sorted(got) == sorted(leaves(json.loads(text), "m"))


def test_invalid_and_twice_encoded():
    for bad in (None, "", '{"a": NaN}', '{"a": [1', '{"a":1} x', '{"a":[{}],}', "[{},]", '{"a" 1}', "[1 2]", '{"a":[{}]}}', '"x" "y"', "[01]", '["\x01"]'):
        assert N.triples(bad, "m") == []
    assert N.objects(json.dumps(json.dumps({"a": [{}]})), "m") == [("m.a[0]", "")]
    assert N.objects('{"a": "[{}]"}', "m") == [] and N.objects(json.dumps(json.dumps(json.dumps([{}]))), "m") == []
    assert N.objects('{"a":[{},{}],"a":[{}]}', "m") == [("m.a[0]", "")]
    assert [t[5] for t in N.triples('["\\ud800x", "\\u00e9", "a\\"b"]', "m")] == ["\ufffdx", "é", 'a"b']


def test_very_deep():
    text = '{"a":[' * 6000 + "1" + "]}" * 6000
    assert len(N.objects(text, "m")) == 5999


def test_frames(spark):
    schema = "id bigint, m string, t array<struct<x:int,y:array<struct<z:string>>>>, elem_path string"
    rows = [(1, '{"a":[null,{"b":[{}]}]}', [(1, [("p",), None])], "clash"), (1, '{"a":[null,{"b":[{}]}]}', [(1, [("p",), None])], "clash"), (2, None, None, None), (3, "x", [], None), (None, "[]", [None], None)]
    got = sorted(map(tuple, N.element_objects(N.nested_triples(spark.createDataFrame(rows, schema), "id", ["m", "t"]), "id").collect()))
    assert got == [(1, "m.a[1]", ""), (1, "m.a[1].b[0]", "m.a[1]"), (1, "t[0]", ""), (1, "t[0].y[0]", "t[0]")]
    assert N.nested_triples(spark.createDataFrame([], schema), "id", ["m", "t"]).count() == 0
    found = N.nested_triples(spark.createDataFrame(rows, schema), "id", ["t"])
    assert [tuple(r) for r in N.nested_table(found, "id", "t[].y[]", ["z"]).collect()] == [(1, "t[0].y[0]", "t[0]", 0, "p")]


def test_a_table_for_each_group(spark):
    m = '{"n":1,"a":[{"x":"p","tags":["u","v"],"b":[{"y":2},{}]},{"x.z":3,"x_z":4,"id":5}],"e":[{}]}'
    found = N.nested_triples(spark.createDataFrame([(1, m), (2, None)], "id bigint, m string"), "id", ["m"])
    assert sorted(map(tuple, N.element_objects(found, "id").collect())) == [(1, "m.a[0]", ""), (1, "m.a[0].b[0]", "m.a[0]"), (1, "m.a[0].b[1]", "m.a[0]"), (1, "m.a[1]", ""), (1, "m.e[0]", "")]
    tables = N.nested_tables(found, "id")
    assert set(tables) == {"m", "m.a[]", "m.a[].b[]", "m.e[]"}
    rows = {r.elem_path: r for t in tables.values() for r in t.collect()}
    assert rows["m"].n == "1" and rows["m"].ordinal is None and rows["m.a[0]"].x == "p" and rows["m.a[0]"].tags == ["u", "v"]
    assert [rows["m.a[1]"][c] for c in ("x_z", "x_z_2", "id_2")] == ["3", "4", "5"] and rows["m.a[0].b[0]"].y == "2" and rows["m.a[0].b[1]"].y is None and rows["m.e[0]"].parent_path == ""


def test_found_goes_by_the_triples(spark):
    from papyra.plans import nested_queries as Q

    data = "/root/testdata/sf0.001"
    got = Q.p3_found(spark, data)
    assert got.columns == ["result_id", "elem_path", "parent_path"] and got.count() > 0
    groups = {r.group_path for r in Q.p3_tables(spark, data).select("group_path").distinct().collect()}
    assert {"tables[]", "chunks[]", "pages[]", "pages[].images[]", "metadata.pages.boundaries[]"} <= groups


def test_cut_off_strings_take_linear_time():
    import time

    t = time.process_time()
    assert N.triples('{"a": "' + "word and more " * 20_000, "m") == [] and N.triples('{"a": "' + "\\\\" * 20_000, "m") == []
    assert time.process_time() - t < 1
