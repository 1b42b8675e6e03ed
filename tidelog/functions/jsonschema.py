"""A subset of JSON Schema compiled to Columns over a parsed payload.

``violations`` walks the schema on the driver and leaves one expression: an array of texts in the
order enum, type, length, range, required, properties, additional properties, items. A wrong type
stops the descent. Supported: type (one or several), required, properties,
additionalProperties false, enum, minLength, maxLength, minimum, maximum, items.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# JSON type names and the variant types they take.
TYPES = {
    "string": ("STRING",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "integer": ("BIGINT",),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "null": ("VOID",),
}


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_type(v: Column, name: str) -> Column:
    k = kind(v)
    test = F.lit(False)
    for t in TYPES.get(name, ()):
        test = test | k.startswith(t)
    if name == "integer":  # integral numbers of other types count
        number = F.try_variant_get(v, "$", "double")
        test = test | (k.startswith("DECIMAL") | k.startswith("DOUBLE")) & (number == F.floor(number))
    return F.coalesce(test, F.lit(False))


def _say(test: Column, text: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))


def _equals(v: Column, value) -> Column:
    """Whether the variant equals a JSON value: numbers by value, and objects whatever the order of their keys."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return is_type(v, "number") & (F.try_variant_get(v, "$", "double") == float(value))
    return F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(value, ensure_ascii=False))))


def _property(v: Column, name: str) -> Column:
    """A property by its name, which may hold any characters."""
    if "'" in name or '"' in name or "\\" in name:
        return F.element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(name))
    return F.try_variant_get(v, f"$['{name}']", "variant")


def violations(schema: dict, v: Column, path: str = "") -> Column:
    """array<string> of what the variant ``v`` breaks."""
    at = path or "<root>"
    found = []
    if isinstance(schema.get("enum"), list):
        equal = F.lit(False)
        for x in schema["enum"]:
            equal = equal | F.coalesce(_equals(v, x), F.lit(False))
        found.append(_say(~equal, f"{at}: not in enum"))
    ok = F.lit(True)
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        ok = F.lit(False)
        for n in names:
            ok = ok | is_type(v, n)
        found.append(_say(~ok, f"{at}: expected {'|'.join(names)}"))
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    string, numeric = is_type(v, "string"), is_type(v, "number")
    deeper = []
    if "minLength" in schema:
        deeper.append(_say(string & (F.char_length(text) < schema["minLength"]), f"{at}: shorter than {schema['minLength']}"))
    if "maxLength" in schema:
        deeper.append(_say(string & (F.char_length(text) > schema["maxLength"]), f"{at}: longer than {schema['maxLength']}"))
    if "minimum" in schema:
        deeper.append(_say(numeric & (number < schema["minimum"]), f"{at}: less than {schema['minimum']}"))
    if "maximum" in schema:
        deeper.append(_say(numeric & (number > schema["maximum"]), f"{at}: more than {schema['maximum']}"))
    is_object = is_type(v, "object")
    keys = F.json_object_keys(F.to_json(v))
    for name in schema.get("required", []):
        deeper.append(_say(is_object & ~F.array_contains(keys, name), f"{at}: missing {name}"))
    for name, sub in schema.get("properties", {}).items():
        child = _property(v, name)
        inner = violations(sub, child, f"{path}.{name}" if path else name)
        deeper.append(F.when(is_object & F.array_contains(keys, name), inner).otherwise(F.array().cast("array<string>")))
    if schema.get("additionalProperties") is False:
        extra = F.array_except(keys, F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>"))
        deeper.append(F.when(is_object, F.transform(extra, lambda k: F.concat(F.lit(f"{at}: unexpected "), k))).otherwise(F.array().cast("array<string>")))
    if isinstance(schema.get("items"), dict):
        parts = F.try_variant_get(v, "$", "array<variant>")
        each = F.transform(parts, lambda x, i: F.transform(violations(schema["items"], x, f"{path}[#]"), lambda t: F.replace(t, F.lit("[#]"), F.concat(F.lit("["), i.cast("string"), F.lit("]")))))
        deeper.append(F.when(is_type(v, "array"), F.flatten(each)).otherwise(F.array().cast("array<string>")))
    if deeper:
        found.append(F.when(ok, F.concat(*deeper)).otherwise(F.array().cast("array<string>")))
    return F.concat(*found) if found else F.array().cast("array<string>")
