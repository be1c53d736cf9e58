"""Deeply nested JSON to flat tables that keep parent-child links.

Everything is one projection per ``LEVELS`` levels of nesting: a frontier of containers is an array column, a ``transform`` turns
each into the array of its children with their path and the path of their enclosing element attached, ``flatten`` joins those
arrays, and one ``inline`` per target table emits rows.  The JSON is parsed once, by the JVM, into VARIANT; a string that is itself
JSON text of an object or array is opened where it stands.  No Python and no shuffle take part.  Records nested deeper than
``LEVELS`` keep their open frontier in the written table and go through the same projection again, until none is open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import Scratch

LEVELS = 12

_PLAIN = "'path', n.path, 'parent', n.parent, 'member', n.member, 'position', n.position, 'in_array', n.in_array"
_AS_MAP, _AS_ARRAY = "try_variant_get({0}, '$', 'map<string, variant>')", "try_variant_get({0}, '$', 'array<variant>')"


def _typed(nodes: str) -> str:
    """``nodes`` with their members or elements; a string that is JSON text of an object or array is opened first.

    Each step is a ``transform`` of its own, so nothing is evaluated twice, and only strings that look like JSON are parsed."""
    cast = f"transform({nodes}, n -> named_struct({_PLAIN}, 'v', n.v, 'm', {_AS_MAP.format('n.v')}, 'a', {_AS_ARRAY.format('n.v')}))"
    text = "case when n.m is null and n.a is null then try_variant_get(n.v, '$', 'string') end"
    seen = f"transform({cast}, n -> named_struct({_PLAIN}, 'v', n.v, 'm', n.m, 'a', n.a, 't', {text}))"
    inner = f"transform({seen}, n -> named_struct({_PLAIN}, 'v', n.v, 'm', n.m, 'a', n.a, 'u', case when n.t rlike '^\\\\s*[\\\\[{{]' then try_parse_json(n.t) end))"
    again = f"transform({inner}, n -> named_struct({_PLAIN}, 'v', n.v, 'm', n.m, 'a', n.a, 'u', n.u, 'um', case when n.u is not null then {_AS_MAP.format('n.u')} end, 'ua', case when n.u is not null then {_AS_ARRAY.format('n.u')} end))"
    return f"transform({again}, n -> named_struct({_PLAIN}, 'v', case when n.um is null and n.ua is null then n.v else n.u end, 'm', coalesce(n.m, n.um), 'a', coalesce(n.a, n.ua)))"


#: the children of a container n, as an array
_CHILDREN = """case when n.m is not null
then transform(map_entries(n.m), e -> named_struct('path', concat(n.path, '.', e.key), 'parent', case when n.in_array then n.path else n.parent end, 'member', e.key, 'position', cast(null as int), 'in_array', false, 'v', e.value))
else transform(n.a, (x, i) -> named_struct('path', concat(n.path, '[', i, ']'), 'parent', n.parent, 'member', n.member, 'position', i, 'in_array', true, 'v', x)) end"""
_CONTAINER = "n.m is not null or n.a is not null"
_SHAPE = "case when n.m is not null then 'object' when n.a is not null then 'array' else 'value' end"


def _peel(df: DataFrame, keep: list[str], levels: int, wanted: str, values: bool) -> DataFrame:
    """``df``(keep, frontier) with the ``wanted`` nodes of the next levels in one array and what is still open in another."""
    for k in range(levels):
        below = _typed(f"flatten(transform(f{k}, n -> {_CHILDREN}))")
        df = df.select("*", F.expr(below).alias(f"all{k + 1}")).select("*", F.expr(f"filter(all{k + 1}, n -> {_CONTAINER})").alias(f"f{k + 1}"))
    value = "to_json(n.v)" if values else "cast(null as string)"
    nodes = F.concat(*[F.expr(f"transform(filter(all{k + 1}, n -> {wanted}), n -> named_struct({_PLAIN}, 'shape', {_SHAPE}, 'value', {value}))") for k in range(levels)])
    open_ = F.expr(f"transform(f{levels}, n -> named_struct({_PLAIN}, 'v', to_json(n.v)))")
    return df.select(*keep, nodes.alias("nodes"), open_.alias("open"))


def _tree(df: DataFrame, keys: list[str], texts: list[str], levels: int, wanted: str, values: bool) -> DataFrame:
    s = Scratch(df.sparkSession, "nested")
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(t).alias("text_column"), F.col(t).alias("text")) for t in texts])).alias("x"))
    long = long.select(*keys, "x.text_column", "x.text")
    if "in_array" in wanted:  # a text without an opening bracket, or the escape of one, has no array
        long = long.filter(F.col("text").contains("[") | F.lower("text").contains("\\u005b"))
    keep = [*keys, "text_column"]
    root = _typed("array(named_struct('path', '$', 'parent', '$', 'member', cast(null as string), 'position', cast(null as int), 'in_array', false, 'v', v))")
    parsed = long.select(*keep, F.expr("try_parse_json(text)").alias("v")).filter("v is not null")
    todo = parsed.select(*keep, F.expr(root).alias("roots")).select(*keep, F.expr(f"filter(roots, n -> {_CONTAINER})").alias("f0")).filter("size(f0) > 0")
    done = []
    while True:
        step = s.write(_peel(todo, keep, levels, wanted, values), "levels")
        done.append(step.select(*keep, F.inline("nodes")))
        left = step.filter(F.size("open") > 0)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = left.select(*keep, F.expr(_typed(f"transform(open, n -> named_struct({_PLAIN}, 'v', parse_json(n.v)))")).alias("f0"))


def json_nodes(df: DataFrame, keys: list[str], texts: list[str], levels: int = LEVELS) -> DataFrame:
    """One row per member and array element, at any depth, of the JSON texts: (keys, text_column, path, parent, member, position,
    in_array, shape, value).

    Paths start at $, add .key per member and [i] per position; parent is the path of the nearest enclosing object that is an array
    element, or $.  shape is 'object', 'array' or 'value'; value is the node as JSON.
    Nulls, empty texts and texts that aren't valid JSON (cut off, say, with a member name twice, or beyond the size limit of VARIANT) give
    no rows.  Repeated rows give repeated rows.  Other columns
    are ignored.
    """
    return _tree(df, keys, texts, levels, "true", True)


def json_values(df: DataFrame, keys: list[str], texts: list[str], levels: int = LEVELS) -> DataFrame:
    """The rows of ``json_nodes`` that are neither object nor array; containers aren't written out."""
    return _tree(df, keys, texts, levels, f"not ({_CONTAINER})", True)


def json_elements(df: DataFrame, keys: list[str], texts: list[str], levels: int = LEVELS) -> DataFrame:
    """The rows of ``json_nodes`` that are objects and array elements, without their text (value is null)."""
    return _tree(df, keys, texts, levels, "n.in_array and n.m is not null", False)


def element_objects(nodes: DataFrame) -> DataFrame:
    """The table of objects that are array elements."""
    return nodes.filter("in_array and shape = 'object'")
