import json
import random

from pyspark.sql import functions as F

from kelpmill.operators import catalog, completions, templates
from kelpmill.sources import tables


def overlay(layers):
    """{key: (source, place)} of one request's layers, items one after another."""
    found = {}
    for number, items in enumerate(layers):
        for source, key in items:
            if key not in found:
                found[key] = [source, len(found)]
            elif number > 0:
                found[key][0] = source
    return {k: tuple(v) for k, v in found.items()}


def test_overlay_against_a_loop(spark):
    draw = random.Random(2)
    for _ in range(3):
        layers, rows = [], []
        for layer in range(3):
            items = []
            for pos in range(draw.randrange(12)):
                kind = 0 if layer == 0 or pos < 4 else 1
                key = draw.choice("abcdefgh")
                items.append((f"{layer}.{kind}.{pos}", key))
                rows.append(("t", "d", layer, kind, 0, "" if layer else f"{pos:03}", pos if layer else 0, key, "l", "string", [], False, [], 0, f"{layer}.{kind}.{pos}", None))
            layers.append(items)
        schema = "domain_type string, domain_id string, layer int, kind int, neg int, item_id string, pos int, attribute_key string, label string, type string, enum_values array<string>, required_default boolean, tags array<string>, priority int, source string, validation_rules string"
        merged = catalog.candidates(catalog.overlay(spark.createDataFrame(rows, schema)))
        got = {r.attribute_key: (r.source, r["rank"] - 1) for r in merged.collect()}
        assert got == overlay(layers)


def test_layers(spark):
    items = [("a", "bank", None, " key1 ", None, " Enum ", ["X"], True, None, 5), ("b", "bank", None, "key2", "Two", None, None, None, ["t"], None), ("c", "hotel", None, "key3", "Three", "date", None, None, None, 9)]
    docs = [
        ("d1", "domain_type_default", "banking", None, None, [("c", None, "Mine", "JSON", True, ["N"], None), (None, "key2", None, None, None, [], '{"m":1}'), ("zz", "none", None, None, None, None, None)], [("  ", None, None, None, None, None, None), ("own", None, "Number", None, None, 3, None)]),
        ("d2", "other", "x", "id-1", None, [], [("key1", "Over", None, True, ["V"], 1, None)]),
    ]
    asked = spark.createDataFrame([("1", "n", None, "id-1", " Banking ", None), ("2", "n", None, "", None, None), ("3", "n", None, "id-1", None, None)], tables.SCHEMAS["template_requests"])
    found = catalog.with_candidates(asked, catalog.candidates(catalog.overlay(catalog.layers(asked, spark.createDataFrame(items, tables.SCHEMAS["catalog_global"]), spark.createDataFrame(docs, tables.SCHEMAS["catalog_domain"])))))
    got = {r.request_id: [(c.attribute_key, c.label, c.type, c.source, c.priority) for c in r.candidates] for r in found.collect()}
    assert got["1"] == [("key3", "Mine", "json", "domain_ref", 9), ("own", "own", "number", "domain_custom", 3), ("key1", "Over", "string", "domain_custom", 1), ("key2", "Two", "string", "domain_ref", 0)]
    assert got["2"] == [] and got["3"] == [("key1", "Over", "string", "domain_custom", 1)]


def test_envelopes(spark):
    good = json.dumps({"choices": [{"message": {"content": "hi"}}]})
    rows = [("1", 200, good, None), ("2", 200, "<html>", None), ("3", 429, '{"error":"slow"}', None), ("4", 500, "[1]", None), ("5", 200, '{"choices":[]}', None), ("6", None, None, "timeout"), ("7", 200, None, None), ("8", 200, '{"choices":[{"message":{"content":null}}]}', None), ("9", 200, '{"choices":[],"choices":[{"message":{"content":"x","content":"y"}}]}', None)]
    got = {r.request_id: (r.content, r.error_code) for r in completions.parse_completion(spark.createDataFrame(rows, tables.SCHEMAS["completions"])).collect()}
    assert got == {"1": ("hi", None), "2": (None, 502), "3": (None, 429), "4": (None, 500), "5": (None, 502), "6": (None, 502), "7": (None, 502), "8": (None, None), "9": ("y", None)}


def _results(spark, content, **request):
    base = {"request_id": "r", "template_name": "Member Access", "description": None, "domain_id": None, "domain_type": None, "response_mode": None} | request
    asked = spark.createDataFrame([tuple(base.values())], tables.SCHEMAS["template_requests"])
    item = "struct<rank:int,attribute_key:string,label:string,type:string,enum_values:array<string>,required_default:boolean,tags:array<string>,priority:int,source:string,validation_rules:string>"
    asked = asked.withColumn("candidates", F.from_json(F.lit(json.dumps([{"rank": 1, "attribute_key": "Owner Id", "type": "string", "enum_values": [], "required_default": True}])), f"array<{item}>"))
    contents = spark.createDataFrame([("r", content)], "request_id string, content string")
    return templates.template_results(asked, contents).first()


def test_templates(spark):
    raw = {"template_id": None, "templateId": "x", "entity_type": "UPPER_SNAKE_CASE", "description": "a\n\n b ", "attributes": [{"name": "Owner-ID", "type": "date"}, {"name": "Kind", "enum_values": ["P"], "type": "string"}, {"name": "Level", "type": "ENUM", "values": ["b", " Top "]}, {"name": "field_1"}, "text", {"name": 7, "required": "True"}]}
    got = _results(spark, "Sure: " + json.dumps(raw) + " bye", domain_type="real estate")
    assert (got.template_id, got.entity_type, got.version) == ("member_access_v1", "REAL_ESTATE", 1)
    assert got.description.split("\n")[:3] == ["a", "b", "Additional template guidance."]
    assert [(a.name, a.type, a.required, a.enum_values) for a in got.attributes] == [("owner_id", "string", True, []), ("kind", "string", False, []), ("level", "enum", False, ["Top"]), ("7", "string", True, [])]
    assert [a.enumValues for a in got.attributesCamelCase] == [a.enum_values for a in got.attributes]
    text = "Words.\n- name: Shelf Life\ntype: Number, days\nrequired\n- name: Grade\nenum_values: ['High', \"Low\"]\nrequired: no\n- name: shelf-life\n- name: Empty\ntype: enum"
    got = _results(spark, json.dumps({"description": text}), description="kept")
    assert [(a.name, a.type, a.required, a.enum_values) for a in got.attributes][1:] == [("shelf_life", "number", True, []), ("grade", "enum", False, ["High", "Low"]), ("empty", "enum", False, [])]
    assert [a.enumValues for a in got.attributes_compat] == [a.enum_values for a in got.attributes]
    got = _results(spark, '{"description":"a","description":"b","attributes":[{"name":"x","name":"y"}]}')
    assert got.description.startswith("b\n") and [a.name for a in got.attributes][1:] == ["y"]
    got = _results(spark, None, description="kept")
    assert got.description.startswith("kept\n") and got.template_id == "member_access_v1"
    got = _results(spark, "[1, 2]", description="kept")
    assert got.description.startswith("kept\n") and got.template_id == "member_access_v1" and len(got.attributes) == 1


def test_descriptions(spark):
    asked = spark.createDataFrame([(str(k), "My Name", None, None, None, "description_only") for k in range(8)], tables.SCHEMAS["template_requests"])
    contents = ['{"description":"  One\\n two "}', 'x "description": "a \\"q\\" b" {', "- plain  text", "{broken}", "```json\n'quoted'\n```", '{"description": "", "x": 1', '{"description": "a\nb \\"q\\""', '{"description": "a\\nb \\"q\\""']
    rows = completions.description_results(asked, spark.createDataFrame([(str(k), c) for k, c in enumerate(contents)], "request_id string, content string"))
    got = [r.description for r in rows.orderBy("request_id").collect()]
    assert got[:3] == ["One two", 'a "q" b', "plain text"] and got[3].startswith("It organizes") and got[4] == "quoted"
    assert got[5].startswith("It organizes") and got[6:] == ['a b \\"q\\"', 'a b "q"']
    assert {r.entity_type for r in rows.collect()} == {"MY_NAME"}
    full, short = templates.route(asked.withColumn("response_mode", F.when(F.col("request_id") == "0", " Description_ONLY ")))
    assert (full.count(), short.count()) == (7, 1)
    good, bad = templates.reject_blank_template(asked.withColumn("template_name", F.when(F.col("request_id") > "1", "x").otherwise("   ")))
    assert (good.count(), {r.reason for r in bad.collect()}) == (6, {"template_name is required."})
