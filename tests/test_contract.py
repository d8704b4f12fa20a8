"""Contracts in JSON Schema over nested rows."""

import pytest

from stackfolio.operators.contract import Contract, contract_violations

AGENT = {
    "$id": "agent.json", "title": "Agent", "type": "object", "required": ["label", "type"], "additionalProperties": False,
    "properties": {
        "label": {"type": "string", "minLength": 2, "maxLength": 9}, "id": {"$ref": "uri.json"},
        "type": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"enum": ["Person", "Body"]}},
    },
}
FILES = {
    "agent.json": AGENT, "uri.json": {"type": "string", "format": "uri"},
    "work.json": {"definitions": {"year": {"type": "integer", "minimum": 1400, "maximum": 2100}}, "type": "object", "properties": {"year": {"$ref": "#/definitions/year"}}},
}
SCHEMA = {
    "$schema": "x", "type": "object", "required": ["id", "gone"],
    "properties": {
        "id": {"type": "string", "pattern": r"^\d+$"},
        "contribution": {"type": "array", "items": {"type": "object", "properties": {"agent": {"$ref": "agent.json"}, "kind": {"const": "C"}}}},
        "work": {"allOf": [{"$ref": "work.json"}, {"anyOf": [{"required": ["year"]}, {"required": ["note"]}]}]},
        "code": {"oneOf": [{"pattern": "^a"}, {"pattern": "z$"}], "not": {"const": "ab"}},
        "when": {"type": "string", "format": "date-time"}, "size": {"type": ["integer", "string"]}, "flag": {"const": True},
    },
}
KIND = (
    "id string, contribution array<struct<agent: struct<label: string, id: string, type: array<string>, extra: string>, kind: string>>, "
    "work struct<year: int, note: string>, code string, when string, size double, flag boolean"
)


def test_violations_of_each_keyword(spark):
    good = ("1", [((("Ann"), "http://x/1", ["Person"], None), "C")], (1999, None), "ab-", "2020-01-02T03:04:05Z", 2.0, True)
    bad = (
        "x2",
        [(("A", "no uri", ["Person", "Person"], "e"), "C"), (None, "D"), ((None, None, [], None), None), (("too long a name", None, ["Body", "X", "Person"], None), "C"), None],
        (1200, "n"), "abz", "yesterday", 2.5, False,
    )
    rows = spark.createDataFrame([good, bad, ("3", None, (None, None), "ab", None, None, None), ("4", [], (2200, None), "q", "2020-01-02", None, None)], KIND)
    found = {}
    for r in contract_violations(rows, "id", SCHEMA, FILES).collect():
        found.setdefault(r["id"], set()).add((r["path"], r["rule"]))
    gone = ("gone", "required")
    agent = "contribution/{}/agent"
    assert found == {
        "1": {gone},
        "x2": {
            gone, ("id", "pattern"), (agent.format(0) + "/label", "minLength"), (agent.format(0) + "/id", "format"), (agent.format(0) + "/type", "uniqueItems"),
            (agent.format(0) + "/extra", "additionalProperties"), ("contribution/1/kind", "const"), (agent.format(2) + "/label", "required"),
            (agent.format(2) + "/type", "minItems"), (agent.format(3) + "/label", "maxLength"), (agent.format(3) + "/type", "maxItems"),
            (agent.format(3) + "/type/1", "enum"), ("work/year", "minimum"), ("code", "oneOf"), ("when", "format"), ("size", "type"), ("flag", "const"),
        },
        "3": {gone, ("work", "anyOf"), ("code", "not")},
        "4": {gone, ("work/year", "maximum"), ("code", "oneOf"), ("when", "format")},
    }


def test_what_cannot_be_checked_is_refused(spark):
    rows = spark.createDataFrame([("1",)], "id string")
    for schema in ({"patternProperties": {}}, {"properties": {"id": {"$ref": "none.json"}}}, {"properties": {"id": {"const": {}}}}):
        with pytest.raises(ValueError):
            contract_violations(rows, "id", schema)
    assert contract_violations(rows, "id", {"properties": {"id": {"type": "integer"}}}).collect() == [("1", "id", "type")]
    assert contract_violations(rows, "id", True).count() == 0
    assert [r["rule"] for r in contract_violations(rows, "id", {"properties": {"id": False}}).collect()] == ["false"]
    assert Contract(SCHEMA, FILES).files["agent.json"] is AGENT
