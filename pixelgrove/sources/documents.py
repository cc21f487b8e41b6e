"""Requests that come as JSON documents: parsed as VARIANT, checked field by field, refused with the first bad one's name.

A document with one picture carries it in base64 beside a ``pipeline``; one of a batch has the pipeline's fields at its
top level and ``files``. Fields are looked at in the order of the lists below: one that must be there and is not is
``missing``, one of another type or outside its values is ``wrong_type``. A field with a default may be left out, not be
null; an optional one may be both. Fields that no list has are ignored, and named in ``unknown``.
"""

from __future__ import annotations

from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..operators.batch import ENVELOPE

# What fields of a fixed set may hold.
FITS = ("contain", "cover", "fill", "width", "height")
FILTERS = ("lanczos3", "catmull_rom", "triangle", "nearest", "box")
TURNS = ("normal", "mirror_horizontal", "rotate180", "mirror_vertical", "mirror_horizontal_rotate270", "rotate90", "mirror_horizontal_rotate90", "rotate270")
SPACES = ("untagged", "srgb", "display_p3", "other")
_FORMATS, _CHROMA = tuple(r[0] for r in tables.FORMATS), tuple(r[0] for r in tables.CHROMA)
# Bytes that a whole document may have.
MOST_DOCUMENT = 64 << 20

REQUIRED, OPTIONAL = object(), object()
#: Whole numbers of a field by their most, and names.
_BYTE, _SIDE, _LONG, _TEXT, _FLAG, _OBJECT = 255, (1 << 32) - 1, (1 << 63) - 1, "text", "flag", "object"

# A field, what it holds, and whether it must be there, may be null, or what it is otherwise.
PIPELINE = [
    ("crop", _OBJECT, OPTIONAL), ("crop.x", _SIDE, REQUIRED), ("crop.y", _SIDE, REQUIRED), ("crop.width", _SIDE, REQUIRED), ("crop.height", _SIDE, REQUIRED), ("orientation", TURNS, OPTIONAL),
    ("resize", _OBJECT, OPTIONAL), ("resize.width", _SIDE, OPTIONAL), ("resize.height", _SIDE, OPTIONAL), ("resize.fit", FITS, REQUIRED), ("resize.filter", FILTERS, REQUIRED), ("resize.no_upscale", _FLAG, REQUIRED),
    ("strip_metadata", _FLAG, REQUIRED), ("chroma_subsampling", _CHROMA, "luma420"),
    ("colour", _OBJECT, None), ("colour.working_space", SPACES, "srgb"), ("colour.keep_source_pixels", _FLAG, False), ("colour.embed_profile", _FLAG, False),
]
SETTINGS = [("format", _FORMATS, REQUIRED), ("quality", _BYTE, 85), ("progressive", _FLAG, False), ("target", _LONG, OPTIONAL), ("animation", ("keep", "first_frame"), "keep"), ("mobile_limits", _FLAG, False)]
SINGLE = [("pipeline", _OBJECT, REQUIRED), *((f"pipeline.{f}", k, d) for f, k, d in PIPELINE), *SETTINGS, ("name", _TEXT, ""), ("data_base64", _TEXT, REQUIRED), ("strip_metadata", _FLAG, OPTIONAL)]
BATCH = [
    *PIPELINE, *SETTINGS, ("policy", _OBJECT, None), ("policy.deduplicate", _FLAG, REQUIRED), ("policy.skip_unprocessable", _FLAG, REQUIRED), ("policy.skip_upscales", _FLAG, REQUIRED), ("cancel", _LONG, OPTIONAL), ("files", "list", REQUIRED),
]


def _expected(kind) -> str:
    if isinstance(kind, tuple):
        return "one of " + ", ".join(kind)
    return f"a whole number of 0 to {kind}" if isinstance(kind, int) else {_TEXT: "a text", _FLAG: "true or false", _OBJECT: "an object", "list": "a list"}[kind]


def _is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT<"), F.lit(False))


def _place(field: str) -> str:
    """The column that :func:`_opened` makes of an object; "" is the document."""
    return "in_" + field.replace(".", "_")


def _own(fields: list[tuple], parent: str) -> list[tuple]:
    """(name, field, kind) of the fields that stand right in an object."""
    return [(f.rpartition(".")[2], f, k) for f, k, _ in fields if f.rpartition(".")[0] == parent]


def _opened(df: DataFrame, fields: list[tuple]) -> DataFrame:
    """df with a column for the document and for each object among the fields: its own fields as variants, null where it is no object.

    An object is read in one pass over what it has. Paths are for what is there: one that leads nowhere costs an exception a value.
    """
    objects = ["", *[f for f, k, _ in fields if k == _OBJECT]]
    depth = lambda f: f.count(".") + bool(f)
    for level in range(max(map(depth, objects)) + 1):
        new = {}
        for field in (f for f in objects if depth(f) == level):
            parent, _, name = field.rpartition(".")
            kinds = ",".join(f"{n}:" + ("array<variant>" if k == "list" else "variant") for n, _, k in _own(fields, field))
            new[_place(field)] = F.try_variant_get(F.col(_place(parent))[name] if field else F.col("doc"), "$", f"struct<{kinds}>")
        df = df.withColumns(new)
    return df


def _held(doc: Column, fields: list[tuple]) -> Column:
    """What the document holds at each field, as an array of schemas: null where the field is left out, "" for what should be a list and is none.

    Of objects and lists, which may be long, it is only said that they are such.
    """
    def one(field: str, kind) -> Column:
        parent, _, name = field.rpartition(".")
        value = F.col(_place(parent))[name]
        if kind == "list":
            return F.when(value.isNotNull(), "ARRAY<").when(F.try_variant_get(doc, f"$.{field}", "variant").isNotNull(), "")
        schema = F.schema_of_variant(value)
        return F.when(F.col(_place(field)).isNotNull(), "OBJECT<").otherwise(schema) if kind == _OBJECT else schema

    return F.array(*[one(f, k) for f, k, _ in fields])


def _first_error(raw: Column, held: Column, fields: list[tuple]) -> Column:
    """struct(error, field, expected) of the first bad field, null if there is none; ``raw`` holds the values by :func:`_type`, ``held`` is what :func:`_held` gives.

    One CASE an object stops at its first fault and says its number, by which the fault is looked up among fixed ones; an object
    that is left out is passed by. It is walked as an expression, by way of a lambda: its generated code would be longer
    than what the JVM compiles.
    """
    at = {f: k for k, (f, _, _) in enumerate(fields)}
    kept_apart = {f for f, _, o in fields if o is OPTIONAL or o is None}
    starts = {_TEXT: "STRING", _FLAG: "BOOLEAN", _OBJECT: "OBJECT<", "list": "ARRAY<"}
    found, faults = [], []
    for parent, group in groupby(fields, lambda f: f[0].rpartition(".")[0]):
        code = F
        for field, kind, otherwise in group:
            here = F.get(held, at[field])
            right = here.startswith("STRING" if isinstance(kind, tuple) else "BIGINT" if isinstance(kind, int) else starts[kind])
            if isinstance(kind, int):
                right &= reduce(lambda c, n: c[n], field.split("."), raw).between(0, kind)
            elif isinstance(kind, tuple):
                right &= reduce(lambda c, n: c[n], field.split("."), raw).isin(*kind)
            if otherwise is OPTIONAL:
                right |= here == "VOID"
            for error, wrong in (("missing", here.isNull()), ("wrong_type", ~right)):
                if error == "missing" and otherwise is not REQUIRED:
                    continue
                code = code.when(wrong, F.lit(len(faults)))
                faults.append(F.struct(F.lit(error).alias("error"), F.lit(field).alias("field"), F.lit(_expected(kind)).alias("expected")))
        found.append(F.when(F.get(held, at[parent]).startswith("OBJECT<"), code) if parent in kept_apart else code)
    return F.get(F.transform(F.array(F.coalesce(*found)), lambda k: F.get(F.array(*faults), k)), 0)


def _type(fields: list[tuple], prefix: str = "") -> str:
    """The fields as a struct's type; pictures are not among them."""
    own = [(f.removeprefix(prefix), f, k) for f, k, _ in fields if f.startswith(prefix) and "." not in f.removeprefix(prefix) and k != "list" and f != "data_base64"]
    names = {_TEXT: "string", _FLAG: "boolean"}
    return "struct<" + ",".join(f"{n}:" + (_type(fields, f"{f}.") if k == _OBJECT else "bigint" if isinstance(k, int) else "string" if isinstance(k, tuple) else names[k]) for n, f, k in own) + ">"


def _filled(raw: Column, fields: list[tuple], prefix: str = "") -> Column:
    """The read struct with defaults in place of what was left out."""
    out = []
    for field, kind, otherwise in fields:
        name = field.removeprefix(prefix)
        if not field.startswith(prefix) or "." in name or kind == "list" or field == "data_base64":
            continue
        value = raw[name]
        if kind == _OBJECT:
            built = _filled(value, fields, f"{field}.")
            out.append((F.when(value.isNotNull(), built) if otherwise is OPTIONAL else built).alias(name))
            continue
        if prefix == "policy.":
            otherwise = True  # a batch without a policy deduplicates and skips
        out.append((value if otherwise in (REQUIRED, OPTIONAL) else F.coalesce(value, F.lit(otherwise))).alias(name))
    return F.struct(*out)


def _unknown(doc: Column, fields: list[tuple]) -> Column:
    """Names at the top of the document that no list has, in order."""
    names = F.map_keys(F.try_variant_get(doc, "$", "map<string,variant>"))
    return F.array_sort(F.array_except(names, F.array(*[F.lit(f) for f, _, _ in fields if "." not in f])))


def _checked(df: DataFrame, column: str, fields: list[tuple]) -> DataFrame:
    """df with doc, in_ (as :func:`_opened` makes it of the document), request, unknown and bad: struct(error, field, expected)."""
    size = F.octet_length(column)
    df = _opened(df.withColumn("doc", F.when(size <= MOST_DOCUMENT, F.try_parse_json(column))), fields)
    df = df.withColumns({"held": _held(F.col("doc"), fields), "raw": F.try_variant_get("doc", "$", _type(fields)), "is_object": F.col(_place("")).isNotNull()})
    top = lambda e, x: F.struct(F.lit(e).alias("error"), F.lit("$").alias("field"), F.lit(x).alias("expected"))
    found = _first_error(F.col("raw"), F.col("held"), fields)
    bad = F.when(size > MOST_DOCUMENT, top("too_large", "")).when(F.col("doc").isNull(), top("not_json", "")).when(~F.col("is_object"), top("wrong_type", "an object")).otherwise(found)
    df = df.withColumns({"bad": bad, "unknown": _unknown(F.col("doc"), fields)})
    return df.withColumn("request", _filled(F.col("raw"), fields)).drop("raw", "held", "is_object", *[_place(f) for f, k, _ in fields if k == _OBJECT])


def sentence(error: Column, field: Column, expected: Column, size: Column) -> Column:
    """What is said of a refused document; null where there is no error."""
    large = F.concat(F.lit("this request is "), size.cast("string"), F.lit(f" bytes and one request may be at most {MOST_DOCUMENT} bytes; export in smaller groups"))
    return (
        F.when(error == "missing", F.concat(F.lit("bad request: missing field `"), field, F.lit("`"))).when(error == "wrong_type", F.concat(F.lit("bad request: `"), field, F.lit("` must be "), expected))
        .when(error == "not_json", "bad request: this is not JSON").when(error == "too_large", large).when(error == "not_base64", "data_base64 is not valid base64").when(error == "no_data", "request contained no image data")
    )


def single_requests(df: DataFrame, column: str = "json") -> DataFrame:
    """df with request, bytes, unknown, error, field, sentence of documents with one picture each; request and bytes are null where there is an error.

    ``strip_metadata`` at the top wins over the pipeline's. Null documents and empty ones are ``not_json``.
    """
    text = F.trim(F.try_variant_get("doc", "$.data_base64", "string"))
    # By steps: a picture that one step names several times is decoded as often.
    checked = _checked(df, column, SINGLE).withColumn("bytes", F.try_to_binary(text, F.lit("base64")))
    out = checked.withColumn("error", F.coalesce("bad.error", F.when(F.col("bytes").isNull(), "not_base64").when(F.length("bytes") == 0, "no_data")))
    out = out.withColumn("field", F.coalesce("bad.field", F.when(F.col("error").isNotNull(), "data_base64")))
    strip = F.coalesce("request.strip_metadata", "request.pipeline.strip_metadata")
    request = F.col("request").dropFields("strip_metadata").withField("pipeline.strip_metadata", strip)
    ok = F.col("error").isNull()
    says = sentence(F.col("error"), F.col("field"), F.col("bad.expected"), F.octet_length(column))
    return out.withColumns({"sentence": says, "request": F.when(ok, request), "bytes": F.when(ok, F.col("bytes"))}).drop("doc", _place(""), "bad")


def batch_rows(df: DataFrame, key: str = "id", column: str = "json", *, files: int = ENVELOPE[0], file_bytes: int = ENVELOPE[1], total_bytes: int = ENVELOPE[2]) -> DataFrame:
    """key, request, unknown, files, bytes, error, field, sentence, contents of documents with many pictures, refused as a whole.

    contents: array of struct(ordinal, name, bytes), null where there is an error. A file is an object with a text ``name`` and
    ``bytes``, a list of whole numbers of 0 to 255. Files are read in order, and the first that is none or breaks the envelope
    refuses its document. A document is one row throughout: nothing is shuffled, and keys may repeat.
    """
    checked = _checked(df.select(key, column), column, BATCH)

    # By steps, as a value that a lambda names twice is made twice.
    def taken(file: Column, k: Column) -> Column:
        get = lambda f, kind: F.try_variant_get(file, f"$.{f}", kind)
        return F.struct(k.alias("ordinal"), file.alias("file"), F.schema_of_variant(get("name", "variant")).alias("kind"), get("name", "string").alias("name"), get("bytes", "string").alias("listed"))

    def numbered(t: Column) -> Column:
        # Of whole numbers alone: nothing but digits and commas within one pair of brackets.
        plain = t["listed"].startswith("[") & (F.length(F.translate(t["listed"], "0123456789,", "")) == 2)
        return F.struct(*[t[c].alias(c) for c in ("ordinal", "file", "kind", "name", "listed")], F.when(plain, F.try_variant_get(t["file"], "$.bytes", "array<int>")).alias("numbers"))

    def read(t: Column) -> Column:
        numbers = t["numbers"]
        right = numbers.isNotNull() & ~F.exists(numbers, lambda v: F.coalesce(v > 255, F.lit(True)))
        wrong = lambda e, f, x: F.struct(F.lit(e).alias("error"), F.concat(F.lit("files["), t["ordinal"].cast("string"), F.lit("]" + f)).alias("field"), F.lit(x).alias("expected"))
        bad = (
            F.when(~_is_object(t["file"]), wrong("wrong_type", "", "an object")).when(t["kind"].isNull(), wrong("missing", ".name", "")).when(t["kind"] != "STRING", wrong("wrong_type", ".name", "a text"))
            .when(t["listed"].isNull() & F.try_variant_get(t["file"], "$.bytes", "variant").isNull(), wrong("missing", ".bytes", "")).when(~F.coalesce(right, F.lit(False)), wrong("wrong_type", ".bytes", "a list of whole numbers of 0 to 255"))
        )
        return F.struct(t["ordinal"].alias("ordinal"), t["name"].alias("name"), numbers.alias("numbers"), bad.alias("bad"))

    def judged(state: Column, file: Column) -> Column:
        size = F.coalesce(F.size(file["numbers"]), F.lit(0)).cast("long")
        total = state["total"] + size
        rule = F.when(file["ordinal"] >= files, "too_many_files").when(size > file_bytes, "file_too_large").when(total > total_bytes, "payload_too_large")
        broken = F.when(rule.isNotNull(), F.struct(rule.alias("error"), F.lit("files").alias("field"), F.concat(file["name"], F.lit(" is "), size.cast("string")).alias("expected")))
        return F.struct(total.alias("total"), F.coalesce(state["bad"], file["bad"], broken).alias("bad"))

    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("struct<error:string,field:string,expected:string>").alias("bad"))
    out = checked.withColumn("list", F.transform(F.transform(F.transform(F.when(F.col("bad").isNull(), F.col(_place(""))["files"]), taken), numbered), read)).withColumn("end", F.aggregate("list", start, judged))
    out = out.withColumn("bad", F.coalesce("bad", "end.bad"))
    error, field, expected = F.col("bad.error"), F.col("bad.field"), F.col("bad.expected")
    says = (
        F.when(error == "too_many_files", f"this request carries more than {files} files; export them in smaller groups")
        .when(error == "file_too_large", F.concat(expected, F.lit(f" bytes and one file in a request may be at most {file_bytes} bytes")))
        .when(error == "payload_too_large", f"the files in this request add up to more than {total_bytes} bytes; export them in smaller groups")
        .otherwise(sentence(error, field, expected, F.octet_length(column)))
    )
    ok = F.col("bad").isNull()
    binary = lambda numbers: F.unhex(F.array_join(F.transform(numbers, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    contents = F.transform("list", lambda t: F.struct(t["ordinal"].alias("ordinal"), t["name"].alias("name"), binary(t["numbers"]).alias("bytes")))
    return out.select(
        key, F.when(ok, F.col("request")).alias("request"), "unknown", F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("files"), F.coalesce("end.total", F.lit(0)).alias("bytes"), error.alias("error"), field.alias("field"), says.alias("sentence"),
        F.when(ok, contents).alias("contents"),
    )


def batch_requests(df: DataFrame, key: str = "id", column: str = "json", **limits: int) -> tuple[DataFrame, DataFrame]:
    """(verdicts, files): what :func:`batch_rows` gives, apart. Who needs both does better with its rows, as each of the two reads all documents.

    verdicts: all but contents. files: key, ordinal, name, bytes of the documents that passed, in their order.
    """
    rows = batch_rows(df, key, column, **limits)
    # A filter on documents would go below all that judges them, and judge once more for every mention.
    each = rows.select(key, F.explode_outer("contents").alias("file")).filter("file IS NOT NULL")
    return rows.drop("contents"), each.select(key, "file.ordinal", "file.name", "file.bytes")
