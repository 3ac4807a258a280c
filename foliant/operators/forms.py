"""Nested JSON forms: validation against a schema, leaves, and evidence."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: object, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def schema_errors(value: object, rule: dict, root: dict, at: str = "$") -> Iterator[tuple[str, str]]:
    """(path, keyword) of everything in ``value`` that breaks ``rule`` (Q01).

    Known keywords: $ref into the root, anyOf, allOf, if/then/else, const, enum, type, required, properties, additionalProperties
    false, items, minItems, uniqueItems, minLength, pattern and format date. Others are ignored."""
    if "$ref" in rule:
        target: object = root
        for part in rule["$ref"].removeprefix("#/").split("/"):
            target = target[part]
        yield from schema_errors(value, target, root, at)
    for sub in rule.get("allOf", ()):
        yield from schema_errors(value, sub, root, at)
    if "anyOf" in rule and all(any(True for _ in schema_errors(value, sub, root, at)) for sub in rule["anyOf"]):
        yield at, "anyOf"
    if "if" in rule:
        holds = not any(True for _ in schema_errors(value, rule["if"], root, at))
        yield from schema_errors(value, rule.get("then" if holds else "else", {}), root, at)
    if "const" in rule and value != rule["const"]:
        yield at, "const"
    if "enum" in rule and value not in rule["enum"]:
        yield at, "enum"
    kinds = rule.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        yield at, "type"
        return
    if isinstance(value, dict):
        known = rule.get("properties", {})
        yield from ((f"{at}.{k}", "required") for k in rule.get("required", ()) if k not in value)
        for k, v in value.items():
            if k in known:
                yield from schema_errors(v, known[k], root, f"{at}.{k}")
            elif rule.get("additionalProperties") is False:
                yield f"{at}.{k}", "additionalProperties"
    if isinstance(value, list):
        if len(value) < rule.get("minItems", 0):
            yield at, "minItems"
        if rule.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield at, "uniqueItems"
        for i, v in enumerate(value) if "items" in rule else ():
            yield from schema_errors(v, rule["items"], root, f"{at}[{i}]")
    if isinstance(value, str):
        if len(value) < rule.get("minLength", 0):
            yield at, "minLength"
        if "pattern" in rule and not re.search(rule["pattern"], value):
            yield at, "pattern"
        if rule.get("format") == "date" and not real_date(value):
            yield at, "format"


def real_date(text: str) -> bool:
    """A calendar date written YYYY-MM-DD."""
    try:
        return bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", text)) and bool(date.fromisoformat(text))
    except ValueError:
        return False


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("repeated key")
    return dict(pairs)


def _leaves(value: object, at: str = "") -> Iterator[tuple[str, str]]:
    """Every leaf's path and text; list members share their list's path; evidence is no answer."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k != "evidence" and not k.endswith("_evidence"):
                yield from _leaves(v, f"{at}_{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from _leaves(v, at)
    else:
        yield at, "" if value is None else str(value)


def _checked(schema: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for form, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    value = json.loads(text or "", object_pairs_hook=_no_repeats)
                except ValueError:
                    rows.append((form, "$", "json"))
                    continue
                rows += [(form, p, k) for p, k in dict.fromkeys(schema_errors(value, schema, schema))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.types[0], pa.string(), pa.string()))], names=["form", "path", "rule"])

    return run


def validate_forms(forms: DataFrame, form_id: str, body: str, schema: dict) -> DataFrame:
    """(form, path, rule): everything that breaks the schema; a text that is no JSON or repeats a key gives rule ``json`` (Q01, S15). A valid form has no row."""
    rows = forms.select(F.col(form_id).alias("form"), F.col(body).alias("body"))
    return rows.mapInArrow(_checked(schema), f"form {dict(rows.dtypes)['form']}, path string, rule string")


def _leaf_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for form, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rows += [(form, *x) for x in _leaves(json.loads(text or ""))]
            except ValueError:
                continue
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((batch.schema.types[0], pa.string(), pa.string()))], names=["form", "path", "value"])


def form_leaves(forms: DataFrame, form_id: str, body: str) -> DataFrame:
    """(form, path, value) of every answer leaf (N01, N02); forms that are no JSON have none."""
    rows = forms.select(F.col(form_id).alias("form"), F.col(body).alias("body"))
    return rows.mapInArrow(_leaf_rows, f"form {dict(rows.dtypes)['form']}, path string, value string")


def form_health(leaves: DataFrame) -> DataFrame:
    """(path, answered, not_found, not_sure)."""
    v = F.lower(F.trim("value"))
    missing, unsure = v.isin("", "not_found", "none_found"), v.isin("not_sure", "unknown")
    return leaves.groupBy("path").agg(F.count_if(~missing & ~unsure).alias("answered"), F.count_if(missing).alias("not_found"), F.count_if(unsure).alias("not_sure"))


def check_evidence(evidence: DataFrame, units: DataFrame, most_words: int = 40) -> DataFrame:
    """(form, ref, words, fault) from evidence (form, unit_no, ref, words) and units (form, unit_no, body): null, or too long, no such unit, or
    not verbatim, white space aside (Q03). A blank unit is a scan and only warns: ``scan``."""
    from foliant.functions.text import quoted_in, word_count

    j = evidence.join(units.select("form", "unit_no", "body"), ["form", "unit_no"], "left")
    fault = F.when(word_count(F.col("words")) > most_words, "too long").when(F.col("body").isNull(), "no such unit").when(F.trim("body") == "", "scan").when(~quoted_in(F.col("words"), F.col("body")), "not verbatim")
    return j.select("form", "ref", "words", fault.alias("fault"))
