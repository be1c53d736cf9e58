"""Records: canonical hashes, deduplication, masking, secret scan, JSON paths, contract checks."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import Scratch


def canonical_hash(text: Column) -> Column:
    """sha256 of a JSON text in canonical form: members in the order of their names, no white space, as the JVM's VARIANT writes it; of the
    text itself where it isn't JSON; null of null."""
    return F.sha2(F.coalesce(F.to_json(F.try_parse_json(text)), text), 256)


def earliest(records: DataFrame, identity: list[str], at: str, seq: str) -> DataFrame:
    """One record per identity, the earliest, then of smallest ``seq``; rows without ``at`` come after those with."""
    best = Window.partitionBy(*identity).orderBy(F.asc_nulls_last(at), seq)
    return records.withColumn("__n", F.row_number().over(best)).filter("__n = 1").drop("__n")


def teachers(records: DataFrame, model: str) -> DataFrame:
    """(teacher, n): records per teacher, null ones under 'unknown'."""
    return records.groupBy(F.coalesce(model, F.lit("unknown")).alias("teacher")).agg(F.count(F.lit(1)).alias("n"))


def assert_single_teacher(records: DataFrame, model: str) -> None:
    found = [r[0] for r in records.select(F.coalesce(model, F.lit("unknown"))).distinct().limit(6).collect()]
    if len(found) > 1:
        raise ValueError(f"more than one teacher: {sorted(found)}")


# fixed values: what is not printed of a secret, and patterns of secrets by kind
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "access_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36}\b",
    "bearer": r"(?i)\bbearer\s+[A-Za-z0-9._\-]{20,}",
    "assigned": r"(?i)\b(?:api[_-]?key|secret|passwd|password|token)\s*[:=]\s*['\"]?[A-Za-z0-9/+_\-]{16,}",
    "url_password": r"\b[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s:@]+@",
    "jwt": r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
}


def mask(text: Column, least: int = 8) -> Column:
    """Every run of ``least`` or more characters without white space as ***[len=N]; white space stays as it is."""
    words = F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) >= least) & ~w.rlike(r"^\s"), F.concat(F.lit("***[len="), F.length(w), F.lit("]"))).otherwise(w)), "")


def secret_kinds(text: Column) -> Column:
    """The kinds of secrets a text shows, sorted."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in sorted(SECRETS.items())]))


def path_assertion(text: Column, path: str, op: str, target: float | str) -> Column:
    """Whether the value at a dotted path of a JSON text compares; a missing path, a boolean against a number or what can't be compared
    fails."""
    got = F.get_json_object(text, "$." + path)
    number = F.when(~got.isin("true", "false"), got.try_cast("double"))
    tests = {"gte": number >= target, "gt": number > target, "lte": number <= target, "lt": number < target, "eq": (number == target) if isinstance(target, (int, float)) else (got == target)}
    return F.coalesce(tests[op], F.lit(False))


def _fails(schema: dict, root: dict, v: object, path: str, out: list[str]) -> None:
    """Violations of the common part of JSON Schema 2020-12: type, enum, const, bounds, lengths, pattern, required, properties, items, refs,
    combinators."""
    if "$ref" in schema:
        node: dict = root
        for part in schema["$ref"].lstrip("#/").split("/"):
            node = node[part]
        _fails(node, root, v, path, out)
    say = lambda m: out.append(f"{path}: {m}")
    kinds = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}

    def is_kind(t: str) -> bool:
        if t in ("number", "integer"):
            return isinstance(v, (int, float)) and not isinstance(v, bool) and (t == "number" or float(v).is_integer())
        return isinstance(v, kinds[t])

    wanted = schema.get("type")
    if wanted is not None and not any(is_kind(t) for t in ([wanted] if isinstance(wanted, str) else wanted)):
        say(f"is not of type {wanted}")
        return
    if "enum" in schema and v not in schema["enum"]:
        say("is not one of the allowed values")
    if "const" in schema and v != schema["const"]:
        say("is not the required value")
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        bounds: dict[str, Callable] = {"minimum": lambda b: v >= b, "maximum": lambda b: v <= b, "exclusiveMinimum": lambda b: v > b, "exclusiveMaximum": lambda b: v < b}
        for name, holds in bounds.items():
            if name in schema and not holds(schema[name]):
                say(f"violates {name} {schema[name]}")
    if isinstance(v, str):
        if len(v) < schema.get("minLength", 0) or len(v) > schema.get("maxLength", len(v)):
            say("has a wrong length")
        if "pattern" in schema and not re.search(schema["pattern"], v):
            say("does not match the pattern")
    if isinstance(v, dict):
        for name in schema.get("required", []):
            if name not in v:
                say(f"{name} is missing")
        known = schema.get("properties", {})
        for name, value in v.items():
            if name in known:
                _fails(known[name], root, value, f"{path}.{name}", out)
            elif schema.get("additionalProperties") is False:
                say(f"{name} is not allowed")
            elif isinstance(schema.get("additionalProperties"), dict):
                _fails(schema["additionalProperties"], root, value, f"{path}.{name}", out)
    if isinstance(v, list):
        if len(v) < schema.get("minItems", 0) or len(v) > schema.get("maxItems", len(v)):
            say("has a wrong number of items")
        for i, x in enumerate(v):
            if isinstance(schema.get("items"), dict):
                _fails(schema["items"], root, x, f"{path}[{i}]", out)
    for sub in schema.get("allOf", []):
        _fails(sub, root, v, path, out)
    for name in ("anyOf", "oneOf"):
        if name in schema:
            good = 0
            for sub in schema[name]:
                tried: list[str] = []
                _fails(sub, root, v, path, tried)
                good += not tried
            if not good or (name == "oneOf" and good > 1):
                say(f"fits {good} of {name}")


def conformance_errors(schema: dict) -> Callable[[Column], Column]:
    """A column function: the sorted violations of ``schema`` by a JSON text, one entry 'not JSON' where it isn't; null of null.  Fields the
    schema doesn't know are allowed unless it says otherwise."""
    import json

    @F.pandas_udf("array<string>")
    def errors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            found: list[str] = []
            try:
                _fails(schema, schema, json.loads(t), "$", found)
            except ValueError:
                found = ["not JSON"]
            out.append(sorted(found))
        return pd.Series(out)

    return errors


def decoded(text: Column) -> Column:
    """A JSON object's VARIANT, also where the text is JSON quoted once more; null for anything else."""
    once = F.try_parse_json(text)
    inner = F.try_parse_json(F.try_variant_get(once, "$", "string"))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT<")
    return F.when(is_object(once), once).when(is_object(inner), inner)


def truncated(cap: int) -> Callable[[Column], Column]:
    """A column function: a JSON object whose largest members are replaced by stubs until its text has at most ``cap`` bytes."""
    import json

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or len(t.encode()) <= cap:
                return t
            try:
                v = json.loads(t)
            except ValueError:
                return t
            if not isinstance(v, dict):
                return t
            sizes = sorted(((len(json.dumps(x, ensure_ascii=False).encode()), k) for k, x in v.items()), reverse=True)
            for n, k in sizes:
                if len(json.dumps(v, ensure_ascii=False).encode()) <= cap:
                    break
                v[k] = {"truncated": True, "bytes": n}
            return json.dumps(v, ensure_ascii=False)

        return texts.map(one)

    return cut


SOURCES = ("live", "replay", "synthetic")


def built_records(rows: DataFrame, producer: str, columns: dict[str, Column], source: str = "live", version: int = 3) -> DataFrame:
    """Canonical records: schema_version, producer, the given ``columns``, and provenance(source, content_hash), the hash that of input_messages
    (JSON text) in canonical form.  A producer and captured_at are required; rows without captured_at fail the query."""
    if not producer or source not in SOURCES or "captured_at" not in columns:
        raise ValueError("a record needs a producer, a known source and captured_at")
    at = columns["captured_at"]
    checked = columns | {"captured_at": F.when(at.isNull(), F.raise_error(F.lit("captured_at is missing")).cast("string")).otherwise(at.cast("string"))}
    given = columns.get("input_messages", F.lit(None).cast("string"))
    provenance = F.struct(F.lit(source).alias("source"), F.when(given.isNotNull(), canonical_hash(given)).alias("content_hash"))
    return rows.select(F.lit(version).alias("schema_version"), F.lit(producer).alias("producer"), *[c.alias(n) for n, c in checked.items()], provenance.alias("provenance"))


def record_source(text: Column) -> Column:
    """Where a record (JSON text) comes from: provenance.source, else source, else meta.source, where it is a known one; else live."""
    known = lambda p: F.when(F.get_json_object(text, p).isin(*SOURCES), F.get_json_object(text, p))
    return F.coalesce(known("$.provenance.source"), known("$.source"), known("$.meta.source"), F.lit("live"))


def record_hash(text: Column) -> Column:
    """A record's stored content hash, else that of its input messages."""
    stored = F.nullif(F.get_json_object(text, "$.provenance.content_hash"), F.lit(""))
    return F.coalesce(stored, canonical_hash(F.coalesce(F.get_json_object(text, "$.input_messages"), F.lit("null"))))


def is_model_decision(text: Column) -> Column:
    """Whether a decision names the model that made it."""
    return F.get_json_object(text, "$.model_metadata").isNotNull()


def validated(rows: DataFrame, text: str, schema: dict) -> DataFrame:
    """``rows``; one that violates ``schema`` fails the query."""
    found = conformance_errors(schema)(F.col(text))
    return rows.withColumn(text, F.when(F.size(found) > 0, F.raise_error(F.array_join(found, "; ")).cast("string")).otherwise(F.col(text)))


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON, for a text sink."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def strongest(loadings: dict[str, Column]) -> Column:
    """The name of the largest loading, the first of equals; null where one is null."""
    ranked = F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(loadings.items())])
    whole = F.lit(True)
    for v in loadings.values():
        whole = whole & v.isNotNull()
    return F.when(whole, F.array_max(ranked)["n"])


def sums_to_one(values: list[Column], tolerance: float) -> Column:
    total = F.lit(0.0)
    for v in values:
        total = total + v
    return F.coalesce(F.abs(total - 1) <= tolerance, F.lit(False))


def within(values: Column, low: float, high: float) -> Column:
    """Whether every value of a map lies in [low, high]; an empty one does."""
    return F.coalesce(F.forall(F.map_values(values), lambda v: (v >= low) & (v <= high)), F.lit(False))


def agent_schema(agent: Column, schemas: dict[str, str]) -> Column:
    """The schema of an agent by the part of its id before the first colon; null if it has none."""
    pairs = [F.lit(x) for kv in schemas.items() for x in kv]
    return F.create_map(*pairs)[F.split_part(agent, F.lit(":"), F.lit(1))]


def overall_score(scores: list[Column]) -> Column:
    """The mean rounded half to even; null where one is null."""
    total = F.lit(0.0)
    for s in scores:
        total = total + s
    return F.bround(total / len(scores), 0).cast("int")


def trimmed_strings(values: Column) -> Column:
    """The strings without outer blanks, empty ones left out."""
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def choice_faults(primary: Column, secondary: Column) -> Column:
    """What is wrong with a primary choice and a list of secondary ones: 'repeated', 'primary_in_secondary'; sorted."""
    twice = F.size(F.array_distinct(secondary)) != F.size(secondary)
    return F.array_compact(F.array(F.when(F.array_contains(secondary, primary), "primary_in_secondary"), F.when(twice, "repeated")))


CHECK_STATUSES = ("ok", "warn", "fail", "unknown")


def check_results(rows: DataFrame, check: Column, label: Column, status: Column, summary: Column, cadence_minutes: int) -> DataFrame:
    """Envelopes (check_id, label, status, summary, cadence_minutes); a status that isn't one of ``CHECK_STATUSES`` fails the query."""
    if cadence_minutes <= 0:
        raise ValueError("a cadence has at least one minute")
    known = F.when(status.isin(*CHECK_STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce(status, F.lit("null")))).cast("string"))
    return rows.select(check.alias("check_id"), label.alias("label"), known.alias("status"), summary.alias("summary"), F.lit(cadence_minutes).alias("cadence_minutes"))


def collector_errors(rows: DataFrame, by: list[str], status: str) -> DataFrame:
    """(by, n, n_errors): how many collectors ended in 'error'."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(status) == "error").alias("n_errors"))


def self_test(cases: DataFrame, by: list[str], result: str) -> DataFrame:
    """The verdict of a battery of known-answer cases: FAIL with any failed, UNKNOWN with any errored or without cases, else PASS."""
    out = cases.groupBy(*by).agg(F.count(result).alias("n"), F.coalesce(F.bool_or(F.col(result) == "FAIL"), F.lit(False)).alias("f"), F.coalesce(F.bool_or(F.col(result) == "ERROR"), F.lit(False)).alias("e"))
    return out.select(*by, "n", F.when(F.col("f"), "FAIL").when(F.col("e") | (F.col("n") == 0), "UNKNOWN").otherwise("PASS").alias("verdict"))


# fixed value: runs that are binary data in text form and aren't scanned
BLOB = r"[A-Za-z0-9+/]{512,}={0,2}"


def scanned_bodies(bodies: DataFrame, key: str, body: str, clean: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, verdict, rules, cached) of JSON bodies, and the digests of strings found clean, to be given as ``clean``(digest) next time.

    Every string of a body, however deep, is scanned once, however many bodies hold it, and not at all if its digest is known to be clean;
    long blobs are left out.  'block' with the kinds of secrets found, or with 'not JSON' for what isn't; 'ok' otherwise; cached is the
    share of the body's distinct strings that weren't scanned again, 1 without strings.  Null bodies aren't JSON."""
    from tidemark.operators.nested import json_values

    s = Scratch(bodies.sparkSession, "scan")
    rows = bodies.select(F.col(key).alias("key"), F.col(body).alias("body"))
    text = F.try_variant_get(F.try_parse_json("value"), "$", "string")
    leaves = json_values(rows, ["key"], ["body"]).filter(F.startswith("value", F.lit('"'))).select("key", text.alias("leaf")).withColumn("digest", F.sha2("leaf", 256))
    held = s.write(leaves.select("key", "digest", "leaf").dropDuplicates(["key", "digest"]), "leaves")
    known = clean.select("digest").distinct() if clean is not None else held.select("digest").limit(0)
    fresh = held.select("digest", "leaf").dropDuplicates(["digest"]).join(known, "digest", "left_anti")
    scanned = s.write(fresh.select("digest", secret_kinds(F.regexp_replace("leaf", BLOB, "[[blob]]")).alias("kinds")), "scanned")
    per = held.select("key", "digest").join(scanned, "digest", "left").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("kinds", F.array().cast("array<string>")))))).alias("rules"), F.avg(F.col("kinds").isNull().cast("double")).alias("cached"))
    out = rows.select("key", F.try_parse_json("body").isNotNull().alias("sound")).join(per, "key", "left")
    rules = F.when(~F.col("sound"), F.array(F.lit("not JSON"))).otherwise(F.coalesce("rules", F.array().cast("array<string>")))
    verdicts = out.select(F.col("key").alias(key), rules.alias("rules"), F.when(F.col("sound"), F.coalesce("cached", F.lit(1.0))).otherwise(0.0).alias("cached"))
    return verdicts.select(key, F.when(F.size("rules") > 0, "block").otherwise("ok").alias("verdict"), "rules", "cached"), known.unionByName(scanned.filter(F.size("kinds") == 0).select("digest"))
