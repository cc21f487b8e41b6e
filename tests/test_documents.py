"""JSON requests: defaults, and the first bad field by name."""

import base64
import copy
import json

import pytest

from pixelgrove.sources import documents as d

PIPE = {"crop": {"x": 1, "y": 2, "width": 3, "height": 4}, "orientation": "rotate90", "resize": {"width": 10, "height": None, "fit": "width", "filter": "lanczos3", "no_upscale": True}, "strip_metadata": True}
ONE = {"pipeline": PIPE, "format": "jpeg", "data_base64": base64.b64encode(b"picture").decode()}
MANY = PIPE | {"format": "png", "files": [{"name": "a", "bytes": [1, 2, 255]}, {"name": "b", "bytes": []}]}


def changed(doc, path, value=...):
    doc = copy.deepcopy(doc)
    at = doc
    *way, last = path.split(".")
    for step in way:
        at = at[step]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return doc


SINGLE = {
    "good": (ONE, None, None), "no format": (changed(ONE, "format"), "missing", "format"), "format": (changed(ONE, "format", "jpg"), "wrong_type", "format"), "quality": (changed(ONE, "quality", 256), "wrong_type", "quality"),
    "text": (changed(ONE, "quality", "80"), "wrong_type", "quality"), "fraction": (changed(ONE, "quality", 80.5), "wrong_type", "quality"), "null": (changed(ONE, "quality", None), "wrong_type", "quality"),
    "crop": (changed(ONE, "pipeline.crop.width"), "missing", "pipeline.crop.width"), "minus": (changed(ONE, "pipeline.crop.x", -1), "wrong_type", "pipeline.crop.x"), "no crop": (changed(ONE, "pipeline.crop", None), None, None),
    "list": (changed(ONE, "pipeline", [1]), "wrong_type", "pipeline"), "no pipeline": (changed(ONE, "pipeline"), "missing", "pipeline"), "turn": (changed(ONE, "pipeline.orientation", "upside"), "wrong_type", "pipeline.orientation"),
    "colour": (changed(ONE, "pipeline.colour", {"keep_source_pixels": 1}), "wrong_type", "pipeline.colour.keep_source_pixels"), "data": (changed(ONE, "data_base64", "###"), "not_base64", "data_base64"),
    "empty": (changed(ONE, "data_base64", " "), "no_data", "data_base64"), "not": ("nope", "not_json", "$"), "null doc": (None, "not_json", "$"), "number": (3, "wrong_type", "$"),
    "both": (changed(changed(ONE, "format"), "pipeline.strip_metadata", "yes"), "wrong_type", "pipeline.strip_metadata"),
}


def rows(cases):
    return [(k, v if v is None or v == "nope" else json.dumps(v), "x") for k, v in cases.items()]


def test_single(spark):
    df = spark.createDataFrame(rows({k: v[0] for k, v in SINGLE.items()}), "id string, json string, extra string")
    got = {r["id"]: r for r in d.single_requests(df).collect()}
    assert {k: (r["error"], r["field"]) for k, r in got.items()} == {k: v[1:] for k, v in SINGLE.items()}
    good = got["good"]["request"]
    assert (good["quality"], good["progressive"], good["target"], good["animation"], good["pipeline"]["colour"]["working_space"], good["pipeline"]["chroma_subsampling"], good["name"]) == (85, False, None, "keep", "srgb", "luma420", "")
    assert good["pipeline"]["crop"]["height"] == 4 and good["pipeline"]["resize"]["height"] is None and bytes(got["good"]["bytes"]) == b"picture"
    assert got["no crop"]["request"]["pipeline"]["crop"] is None and all((r["request"] is None) == (r["error"] is not None) == (r["sentence"] is not None) for r in got.values())
    assert got["no format"]["sentence"] == "bad request: missing field `format`" and got["quality"]["sentence"] == "bad request: `quality` must be a whole number of 0 to 255"


def test_unknown_fields_and_the_outer_option(spark):
    doc = ONE | {"zoom": 1, "about": {}, "strip_metadata": False}
    got = d.single_requests(spark.createDataFrame(rows({"a": doc}), "id string, json string, extra string")).first()
    assert got["error"] is None and got["unknown"] == ["about", "zoom"] and got["request"]["pipeline"]["strip_metadata"] is False


MANY_CASES = {
    "good": (MANY, None, None), "name": (MANY | {"files": [{"name": 1, "bytes": []}]}, "wrong_type", "files[0].name"), "no name": (MANY | {"files": [{"bytes": []}]}, "missing", "files[0].name"),
    "no bytes": (MANY | {"files": [MANY["files"][0], {"name": "x"}]}, "missing", "files[1].bytes"), "large": (MANY | {"files": [{"name": "x", "bytes": [256]}]}, "wrong_type", "files[0].bytes"),
    "texts": (MANY | {"files": [{"name": "x", "bytes": ["1"]}]}, "wrong_type", "files[0].bytes"), "minus": (MANY | {"files": [{"name": "x", "bytes": [-1]}]}, "wrong_type", "files[0].bytes"),
    "deep": (MANY | {"files": [{"name": "x", "bytes": [[1]]}]}, "wrong_type", "files[0].bytes"), "word": (MANY | {"files": [{"name": "x", "bytes": "12"}]}, "wrong_type", "files[0].bytes"), "no object": (MANY | {"files": [7]}, "wrong_type", "files[0]"),
    "none": (MANY | {"files": []}, None, None), "no list": (MANY | {"files": {}}, "wrong_type", "files"), "no files": (changed(MANY, "files"), "missing", "files"), "policy": (MANY | {"policy": {"deduplicate": True}}, "missing", "policy.skip_unprocessable"),
    "many": (MANY | {"files": [{"name": "x", "bytes": []}] * 4}, "too_many_files", "files"), "wide": (MANY | {"files": [{"name": "x.jpg", "bytes": [0] * 6}]}, "file_too_large", "files"),
    "all": (MANY | {"files": [{"name": "x", "bytes": [0] * 5}] * 2}, "payload_too_large", "files"), "not": ("nope", "not_json", "$"), "null doc": (None, "not_json", "$"),
}


def test_batches(spark):
    df = spark.createDataFrame(rows({k: v[0] for k, v in MANY_CASES.items()}), "id string, json string, extra string")
    verdicts, files = d.batch_requests(df, files=3, file_bytes=5, total_bytes=9)
    got = {r["id"]: r for r in verdicts.collect()}
    assert {k: (r["error"], r["field"]) for k, r in got.items()} == {k: v[1:] for k, v in MANY_CASES.items()}
    assert got["wide"]["sentence"] == "x.jpg is 6 bytes and one file in a request may be at most 5 bytes" and got["good"]["request"]["policy"]["skip_upscales"] is True
    assert sorted((r["id"], r["ordinal"], r["name"], bytes(r["bytes"])) for r in files.collect()) == [("good", 0, "a", b"\x01\x02\xff"), ("good", 1, "b", b"")]
    assert (got["good"]["files"], got["good"]["bytes"], got["none"]["files"]) == (2, 3, 0)


def test_a_text_is_no_list(spark):
    doc = MANY | {"files": [{"name": "x", "bytes": "[1,2]"}, {"name": "y", "bytes": [7, None]}]}
    assert d.batch_requests(spark.createDataFrame(rows({"a": doc}), "id string, json string, extra string"))[0].first()["field"] == "files[0].bytes"


def test_files_parse_a_document_once(spark):
    """No filter goes below what makes it, where it would parse and judge again."""
    _, files = d.batch_requests(spark.createDataFrame([], "id string, json string"))
    assert files._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


@pytest.mark.parametrize("read", [lambda df: d.single_requests(df), lambda df: d.batch_requests(df)[0], lambda df: d.batch_requests(df)[1]])
def test_empty_table(spark, read):
    assert read(spark.createDataFrame([], "id string, json string")).count() == 0


def test_fields_have_fixed_paths(spark):
    """A path that comes from a row is read for every value."""
    out = d.single_requests(spark.createDataFrame([], "id string, json string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get(doc#" in plan and "path, VariantType" not in plan


def test_an_object_is_read_in_one_pass(spark):
    """Not by a path for each field: one that leads nowhere costs an exception a value. What is left are the document, its four objects, the values and the picture."""
    out = d.single_requests(spark.createDataFrame([], "id string, json string")).drop("unknown")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("try_variant_get(") == 7


def test_values_beside_wrong_types(spark):
    """A value that cannot be read takes no other with it, so the first fault is still the first."""
    docs = {"both": changed(changed(ONE, "quality", [1]), "pipeline.crop.x", -1), "later": changed(changed(ONE, "quality", {}), "name", 7), "list": changed(ONE, "pipeline.resize", [1]), "text": changed(ONE, "pipeline.crop", "{}")}
    got = d.single_requests(spark.createDataFrame(rows(docs), "id string, json string, extra string")).collect()
    assert {r["id"]: r["field"] for r in got} == {"both": "pipeline.crop.x", "later": "quality", "list": "pipeline.resize", "text": "pipeline.crop"}


def test_white_space_in_front(spark):
    out = d.single_requests(spark.createDataFrame([("a", "\n\t" + json.dumps(ONE)), ("b", "\r\n [1]")], "id string, json string"))
    assert {r["id"]: (r["error"], r["field"]) for r in out.collect()} == {"a": (None, None), "b": ("wrong_type", "$")}


@pytest.mark.parametrize("name", ["request_documents", "batch_documents"])
def test_documents_are_dealt_before_they_are_checked(spark, tmp_path, name):
    """A file with one row group is one task to read, not to check."""
    from pixelgrove.plans import requests

    spark.range(100).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    plan = requests.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("parseJson") < plan.index("RepartitionByExpression [o_orderkey")
