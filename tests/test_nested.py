import json

import pytest

from tidemark.operators.nested import element_objects, json_elements, json_nodes, json_values


def opened(v):
    if isinstance(v, str):
        try:
            w = json.loads(v)
        except ValueError:
            return v
        if isinstance(w, (dict, list)):
            return w
    return v


def brute(text):
    out = set()
    try:
        v = json.loads(text)
    except (ValueError, TypeError):
        return out

    def walk(v, path, parent, in_array):
        v = opened(v)
        if isinstance(v, dict):
            if in_array:
                out.add((path, parent))
                parent = path
            for k, x in v.items():
                walk(x, f"{path}.{k}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}[{i}]", parent, True)

    walk(v, "$", "$", False)
    return out


TEXTS = [
    '{"a":[{"b":[{"c":1},2,{"d":{"e":[{}]}}]}]}',
    '["[{\\"q\\":1}]"]',
    '"{\\"a\\":[{\\"b\\":\\"[{}]\\"}]}"',
    '{"a.b":[{"c d":[[{}]]}]}',
    '[{"":[{}]}]',
    '{"a":[1,2',
    "",
    "null",
    "5",
    None,
    '[{"x":null}, null, "t", {"y":"{not json"}]',
    '{"a":1} x',
    '"\\u005b{\\"z\\":\\u005b{}]}]"',
    '["\\u005B{}]"]',
    "[" * 15 + "{}" + "]" * 15,
    '{"a":' * 30 + "[{}]" + "}" * 30,
]


def test_elements_match_a_recursive_walk(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)], "k int, t string, nodes string")
    got = {}
    for r in element_objects(json_nodes(df, ["k"], ["t"])).collect():
        got.setdefault(r.k, set()).add((r.path, r.parent))
    for i, t in enumerate(TEXTS):
        assert got.get(i, set()) == brute(t), t
    own = [(r.k, r.path, r.parent) for r in json_elements(df, ["k"], ["t"]).collect()]
    assert sorted(own) == sorted((k, *x) for k, xs in got.items() for x in xs)
    pick = ["k", "path", "parent", "member", "position", "value"]
    values = json_nodes(df, ["k"], ["t"]).filter("shape = 'value'").select(*pick)
    assert sorted(values.collect(), key=repr) == sorted(json_values(df, ["k"], ["t"]).select(*pick).collect(), key=repr)


def test_values_keep_their_parents_and_several_columns(spark):
    df = spark.createDataFrame([(1, '[{"a":1}]', '{"b":[{"c":"x"}]}')], "k int, t string, u string")
    got = {(r.text_column, r.path, r.parent, r.value) for r in json_nodes(df, ["k"], ["t", "u"]).filter("shape = 'value'").collect()}
    assert got == {("t", "$[0].a", "$[0]", "1"), ("u", "$.b[0].c", "$.b[0]", '"x"')}


def test_empty_table(spark):
    assert json_nodes(spark.createDataFrame([], "k int, t string"), ["k"], ["t"]).count() == 0


@pytest.mark.parametrize("copies", [3])
def test_repeated_rows_repeat(spark, copies):
    df = spark.createDataFrame([(1, "[{}]")] * copies, "k int, t string")
    assert element_objects(json_nodes(df, ["k"], ["t"])).count() == copies
