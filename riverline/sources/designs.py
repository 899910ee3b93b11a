"""Design documents, their schema, rule sets, and what depends on what."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The format's version, the number of the older one that is still read, and the stages in their order.
FORMAT, OLDER = "0.4", 3
STAGES = ("sizing", "alignment", "optimise", "volumes")
KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys and no blanks: one text for one value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def breaks(schema: dict, value, at: str = "") -> list[str]:
    """What of a JSON Schema a value breaks, by path: type, enum, const, required, properties, additionalProperties, items, bounds, lengths, anyOf and local $ref."""
    root = schema

    def walk(rule, value, at: str) -> list[str]:
        if rule is True or rule is False:
            return [] if rule else [f"{at or '/'}: nothing is allowed here"]
        if "$ref" in rule:
            target = root
            for part in rule["$ref"].removeprefix("#/").split("/"):
                target = target[part]
            return walk(target, value, at)
        out, place = [], at or "/"
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        kinds = rule.get("type", [])
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if kinds and not any(number if k == "number" else number and float(value).is_integer() if k == "integer" else isinstance(value, KINDS[k]) for k in kinds):
            return [f"{place}: not {' or '.join(kinds)}"]
        if "enum" in rule and value not in rule["enum"] or "const" in rule and value != rule["const"]:
            out.append(f"{place}: not one of the values allowed")
        if "anyOf" in rule and not any(not walk(r, value, at) for r in rule["anyOf"]):
            out.append(f"{place}: fits none of the choices")
        if number:
            low, high = rule.get("minimum"), rule.get("maximum")
            under, over = rule.get("exclusiveMinimum"), rule.get("exclusiveMaximum")
            if (low is not None and value < low) or (high is not None and value > high) or (under is not None and value <= under) or (over is not None and value >= over):
                out.append(f"{place}: out of bounds")
        if isinstance(value, (str, list)):
            least, most = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
            if len(value) < rule.get(least, 0) or len(value) > rule.get(most, len(value)):
                out.append(f"{place}: wrong length")
        if isinstance(value, list) and "items" in rule:
            out += [b for k, v in enumerate(value) for b in walk(rule["items"], v, f"{at}/{k}")]
        if isinstance(value, dict):
            known = rule.get("properties", {})
            out += [f"{at}/{k}: missing" for k in rule.get("required", []) if k not in value]
            for k, v in value.items():
                out += walk(known[k] if k in known else rule.get("additionalProperties", True), v, f"{at}/{k}")
        return out

    return walk(schema, value, at)


def opened(text: str, schema: dict | None = None) -> dict:
    """A design document: refused if it is of another format or breaks the schema; the older number is read as the format of today."""
    doc = json.loads(text)
    if doc.get("format") == OLDER:
        doc["format"] = FORMAT
    if doc.get("format") != FORMAT:
        raise ValueError(f"the document's format is {doc.get('format')!r}, not {FORMAT!r}")
    wrong = breaks(schema, doc) if schema else []
    if wrong:
        raise ValueError("; ".join(wrong))
    return doc


def documents(spark: SparkSession, path: str, schema: dict | None = None) -> DataFrame:
    """(file, project, inputs, stages, options) of design documents, the latter three as JSON text; one file is one row's work."""
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            docs = [opened(t, schema) for t in batch.column("value").to_pylist()]
            part = lambda k: pa.array([canonical(d.get(k)) for d in docs], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array([(d.get("project") or {}).get("name") for d in docs], pa.string()), part("inputs"), part("stages"), part("options")], names=["file", "project", "inputs", "stages", "options"])

    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.mapInArrow(work, "file string, project string, inputs string, stages string, options string")


RULES = "id string, version string, rules array<struct<id:string,measure:string,compare:string,consequence:string,sizes:boolean,applies_when:map<string,array<string>>,limit:map<string,string>>>"


def rule_sets(spark: SparkSession, path: str) -> DataFrame:
    """(set_id, version, content, id, measure, compare, consequence, sizes, applies_when, limit) of rule-set files."""
    d = spark.read.text(path, wholetext=True).select(F.sha2("value", 256).alias("content"), F.from_json("value", RULES, {"mode": "FAILFAST"}).alias("j"))
    return d.select(F.col("j.id").alias("set_id"), F.col("j.version").alias("version"), "content", F.explode("j.rules").alias("r")).select("set_id", "version", "content", "r.*")


def loaded(known: DataFrame, new: DataFrame) -> DataFrame:
    """Known rule sets and new ones; refuses one of a known id and version with other content."""
    key = ["set_id", "version"]
    clash = known.select(*key, F.col("content").alias("old")).distinct().join(new.select(*key, "content").distinct(), key).where("old <> content")
    if not clash.isEmpty():
        raise ValueError("a rule set of this id and version is known with other content")
    return known.unionByName(new.join(known.select(*key).distinct(), key, "left_anti"))


def stage_status(results: Column, recorded: Column, current: Column) -> Column:
    """Not run, fresh or stale; never stored."""
    return F.when(results.isNull(), "not run").when(recorded.eqNullSafe(current), "fresh").otherwise("stale")
