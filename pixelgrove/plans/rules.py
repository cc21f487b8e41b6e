"""Queries of formats, limits, names and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, predicates, tables
from .carriers import PICTURES, jobs, pictures, table


# First bytes of files, with what they are.
HEADS = [
    ("jpeg", "FFD8FFE000104A464946"), ("png", "89504E470D0A1A0A0000000D"), ("gif", "474946383961"), ("gif87", "474946383761"), ("webp", "52494646AABBCCDD57454250"), ("wave", "52494646AABBCCDD57415645"), ("tiff_le", "49492A0008000000"), ("tiff_be", "4D4D002A00000008"), ("bmp", "424D3600"), ("ico", "0000010001001010"),
    ("heic", "00000018667479706865696300000000686569636D696631"), ("mif1_heic", "00000018667479706D696631000000006D69663168656963"), ("avif", "0000001C667479706176696600000000617669666D696631"), ("mp4", "00000018667479706D703432000000006D70343269736F6D"), ("pdf", "255044462D312E37"), ("short", "FFD8"), ("empty", ""), ("msf1", "00000010667479706D73663100000000"), ("compat_only", "0000001C6674797069736F6D0000000069736F6D68656978"),
]
NAMES = ["photo.jpg", "a/b/IMG_1.JPEG", "dir\\x.y.png", "..", "con", "CON.txt", "lpt1.jpg", "nul ", "we!rd@name#.gif", "---", "a..b...c", " spaced name .bmp", "x" * 120 + ".jpg", "noext", ".hidden", "com1.tar.gz", "trailing-", "a/b/", "aux.", "com10.png"]
TAGS = ["GPSLatitude", "gpsAltitude", "BodySerialNumber", "Make", "Artist", "LensModel", "Orientation", "CameraOwnerName", "MakerNote", "DateTime", "ThumbnailOffset", "Copyright", "Model"]


def _values(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def _numbered(spark, values, name):
    """A short list with its places, small enough to be broadcast."""
    return F.broadcast(_values(spark, list(enumerate(values)), f"k int, {name} string"))


def _names(spark, sf_dir):
    """Names of files, a source and what it calls a document, with how many documents have them."""
    docs = table(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % len(NAMES)).cast("int").alias("k")).agg(F.count("*").alias("files"))
    return docs.join(_numbered(spark, NAMES, "own"), "k").select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), "own").alias("name"), "files")


def format_dim(spark, sf_dir):
    """Formats, with the pictures that are to be written as each."""
    wanted = pictures(spark, sf_dir).groupBy((F.col("id") % 10).cast("int").alias("ordinal")).agg(F.count("*").alias("pictures"), F.sum(F.col("w") * F.col("h")).alias("pixels"))
    return F.broadcast(tables.formats(spark).drop("can_decode")).join(wanted, "ordinal")


def chroma_dim(spark, sf_dir):
    """Chroma levels, with the samples of colour that the pictures written at each keep."""
    level = F.element_at(F.array(*[F.lit(r[0]) for r in tables.CHROMA]), (F.col("n") % 3 + 1).cast("int"))
    wanted = pictures(spark, sf_dir).groupBy(level.alias("level")).agg(F.count("*").alias("pictures"), F.sum(F.col("w") * F.col("h")).alias("pixels"))
    return wanted.join(F.broadcast(tables.chroma(spark)), "level").select("level", "label", "samples", "of_samples", "pictures", F.expr("pixels * samples div of_samples").alias("kept"))


def detect_format(spark, sf_dir):
    """Documents behind first bytes of files: what each is taken for, by its own bytes and not by its kind."""
    heads = F.broadcast(_values(spark, [(k, n, h) for k, (n, h) in enumerate(HEADS)], "k int, name string, head string"))
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % len(HEADS)).cast("int").alias("k"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("body"))
    files = docs.join(heads, "k").select("name", F.concat(F.unhex("head"), F.substring("body", 1, 64)).alias("start"), (F.length(F.unhex("head")) + F.octet_length("body")).alias("size"))
    return files.groupBy("name", predicates.detect_format(F.substring("start", 1, 64)).alias("format")).agg(F.count("*").alias("files"), F.sum("size").cast("long").alias("bytes"))


def sniff_documents(spark, sf_dir):
    """No document is a picture."""
    found = predicates.detect_format(F.substring("content", 1, 64))
    return jobs(spark, sf_dir).groupBy(F.coalesce(found, F.lit("not_an_image")).alias("format")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))


def extension_filter(spark, sf_dir):
    return _names(spark, sf_dir).select("name", predicates.has_image_extension(F.col("name")).alias("listed"), predicates.format_of_extension(F.col("name")).alias("format"), "files")


def sanitise_names(spark, sf_dir):
    return _names(spark, sf_dir).select("name", names.sanitise_stem(F.col("name")).alias("stem"), names.sanitise_component(F.col("name")).alias("component"), names.is_reserved(F.col("name")).alias("reserved"), "files")


def sanitise_pages(spark, sf_dir):
    df = table(spark, sf_dir, "pages")
    return df.select("page_id", names.output_name(F.col("url"), F.lit("webp")).alias("output_name"), names.sanitise_component(F.col("url")).alias("component"))


def limits_classify(spark, sf_dir):
    """Pictures of each error under each profile, for stills, streams and animations of n frames."""
    df = pictures(spark, sf_dir).crossJoin(F.broadcast(tables.limits(spark))).withColumns({"w": F.col("w") * 3, "h": F.col("h") * 3})
    p, s = F.col("max_pixels"), F.col("max_side")
    none = F.lit("ok")
    return df.groupBy("profile", F.coalesce(predicates.header_error(F.col("w"), F.col("h"), p, s), none).alias("still"), F.coalesce(predicates.streamed_error(F.col("w"), F.col("h"), p, s), none).alias("streamed"), F.coalesce(predicates.animation_error(F.col("w"), F.col("h"), F.col("n"), p, s), none).alias("animated")).agg(F.count("*").alias("pictures"))


def sensitive_tags(spark, sf_dir):
    """Tags that the orders' photos carry, which of them are sensitive, and on how many photos."""
    carried = table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % len(TAGS)).cast("int").alias("k")).agg(F.count("*").alias("photos"))
    return carried.join(_numbered(spark, TAGS, "tag"), "k").select("tag", predicates.is_sensitive(F.col("tag")).alias("sensitive"), "photos")


def animation_decide(spark, sf_dir):
    formats = F.broadcast(tables.formats(spark).select("format", "supports_animation"))
    policies = F.broadcast(_values(spark, [("keep",), ("first_frame",)], "policy string"))
    df = pictures(spark, sf_dir).select(F.col("n").alias("frames")).groupBy("frames").count().crossJoin(formats).crossJoin(policies)
    df = df.withColumn("action", predicates.animation_action(F.col("frames"), F.col("supports_animation"), F.col("policy")))
    out = predicates.frames_out(F.col("action"), F.col("frames"))
    return df.select("format", "policy", "frames", "action", out.alias("frames_out"), F.greatest(F.lit(0), F.col("frames") - out).alias("dropped"), F.col("count").alias("pictures"))


ENDS = [(True, "", 1, None), (False, "memory allocation of 99 bytes failed", 101, None), (False, "", 0, None), (False, "bad", 2, None), (False, "", 4, None), (False, "", 5, None), (False, "", None, 9), (False, "x", 77, None), (False, "Out of memory", None, 6)]


def sandbox_classify(spark, sf_dir):
    df = _values(spark, ENDS, "timed_out boolean, stderr string, code int, signal int")
    return df.select("timed_out", "stderr", F.coalesce("code", F.lit(-1)).alias("code"), F.coalesce("signal", F.lit(-1)).alias("signal"), predicates.sandbox_outcome(*map(F.col, ("timed_out", "stderr", "code", "signal"))).alias("outcome"))


CONTRACT = [("Job", "id", "string"), ("Job", "name", "string"), ("Job", "bytes", "binary"), ("Crop", "x", "u32")]
SEEN = [("Job", "id", "string"), ("Job", "name", "text"), ("Job", "bytes", "binary"), ("Crop", "y", "u32")]


def contract_drift(spark, sf_dir):
    """What the contract has and a build lacks, and the other way."""
    ddl = "type string, field string, kind string"
    a, b = _values(spark, CONTRACT, ddl), _values(spark, SEEN, ddl)
    on = ["type", "field", "kind"]
    return a.join(b, on, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, on, "left_anti").withColumn("side", F.lit("extra")))


RUNS = [("decode", 42.2, 55.0), ("encode", 153.7, 150.0), ("exif", 0.0156, 0.04), ("resize", 79.8, 91.0)]


def bench_gate(spark, sf_dir):
    df = _values(spark, RUNS, "bench string, baseline_ms double, mean_ms double")
    change = (F.col("mean_ms") / F.col("baseline_ms") - 1) * 100
    return df.select("bench", F.round(change, 4).alias("change_percent"), F.when(F.col("baseline_ms") < 1, "advisory").when(change > 15, "fail").otherwise("pass").alias("verdict"))


_FORMAT_COLUMNS = "format, extension, mime, lossless, read_only, supports_alpha, supports_animation, supports_icc, can_decode"
_HEIF = lambda x: f"CASE WHEN {x} IN ('68656963', '68656978', '6865696D', '68656973', '68657663') THEN 'heic' WHEN {x} IN ('6D696631', '6D736631') THEN 'heif' WHEN {x} IN ('61766966', '61766973') THEN 'avif' END"


def _detect_sql(h: str) -> str:
    at = lambda s, n: f"substr({h}, {2 * s + 1}, {2 * n})"
    box = f"CASE {at(0, 4)} WHEN '00000018' THEN 24 WHEN '0000001C' THEN 28 WHEN '00000010' THEN 16 ELSE 0 END"
    compat = ", ".join(f"CASE WHEN {20 + 4 * i} <= {box} AND length({h}) >= {2 * (20 + 4 * i)} THEN {_HEIF(at(16 + 4 * i, 4))} END" for i in range(3))
    return f"""CASE WHEN {at(0, 3)} = 'FFD8FF' THEN 'jpeg' WHEN {at(0, 8)} = '89504E470D0A1A0A' THEN 'png' WHEN {at(0, 6)} IN ('474946383761', '474946383961') THEN 'gif'
        WHEN {at(0, 4)} = '52494646' AND {at(8, 4)} = '57454250' THEN 'webp' WHEN {at(0, 4)} IN ('49492A00', '4D4D002A') THEN 'tiff' WHEN {at(0, 2)} = '424D' THEN 'bmp' WHEN {at(0, 4)} = '00000100' THEN 'ico'
        WHEN {at(4, 4)} = '66747970' AND {box} >= 16 THEN coalesce({_HEIF(at(8, 4))}, {compat}) END"""


_EXT = "CASE WHEN contains(name, '.') THEN lower(regexp_extract(name, '[^.]*$', 0)) END"
_BASE = "regexp_extract({0}, '[^/\\\\]*$', 0)"
_RESERVED_SQL = "upper(regexp_replace(split_part({0}, '.', 1), '[ .]+$', '')) IN (" + ", ".join(f"'{r}'" for r in names.RESERVED) + ")"


def _names_sql(source: str, name: str, select: str) -> str:
    return f"""WITH src AS ({source}), a AS (SELECT *, regexp_replace(regexp_replace({_BASE.format(name)}, '\\.[^.]*$', ''), '[^\\p{{L}}\\p{{N}}_ -]', '-', 'g') AS s0, regexp_replace(regexp_replace({_BASE.format(name)}, '[^\\p{{L}}\\p{{N}}_.-]', '', 'g'), '\\.+', '.', 'g') AS c0 FROM src),
        b AS (SELECT *, regexp_replace(regexp_replace(s0, '^[- .]+', ''), '[- .]+$', '') AS s1, regexp_replace(regexp_replace(substr(c0, 1, 96), '^\\.+', ''), '\\.+$', '') AS c1 FROM a), c AS (SELECT *, substr(s1, 1, 64) AS s2 FROM b),
        d AS (SELECT *, CASE WHEN s1 = '' THEN 'image' WHEN {_RESERVED_SQL.format('s2')} THEN '_' || s2 ELSE s2 END AS stem, CASE WHEN c1 = '' THEN 'file' WHEN {_RESERVED_SQL.format('c1')} THEN '_' || c1 ELSE c1 END AS component FROM c) SELECT {select} FROM d"""


_NAME_ROWS = f"SELECT coalesce(source, '') || '/' || own AS name, count(*) AS files FROM documents JOIN ({tables.sql_values(list(enumerate(NAMES)))}) t(k, own) ON k = doc_id % {len(NAMES)} GROUP BY source, own"
_LIMIT_SQL = """CASE WHEN greatest(w, h) > s THEN 'suspicious_dimensions' WHEN w * h{0} > {1}p THEN 'pixel_budget_exceeded' ELSE 'ok' END"""

QUERIES = {
    "format_dim": format_dim, "chroma_dim": chroma_dim, "detect_format": detect_format, "sniff_documents": sniff_documents, "extension_filter": extension_filter, "sanitise_names": sanitise_names, "sanitise_pages": sanitise_pages, "limits_classify": limits_classify,
    "sensitive_tags": sensitive_tags, "animation_decide": animation_decide, "sandbox_classify": sandbox_classify, "contract_drift": contract_drift, "bench_gate": bench_gate,
}
SQL = {
    "format_dim": f"WITH {PICTURES}, f(ordinal, {_FORMAT_COLUMNS}) AS ({tables.sql_values([(i, *r) for i, r in enumerate(tables.FORMATS)])}) SELECT ordinal, {_FORMAT_COLUMNS.removesuffix(', can_decode')}, format = 'jpeg' AS supports_progressive, format = 'jpeg' AS supports_chroma, NOT lossless AS supports_quality, NOT lossless AS supports_byte_target, supports_animation AS accepts_multiple_frames, count(*) AS pictures, CAST(sum(w * h) AS BIGINT) AS pixels FROM f JOIN pictures ON id % 10 = ordinal GROUP BY ALL",
    "chroma_dim": f"WITH {PICTURES}, t(k, level, label, samples, of_samples) AS (VALUES (0, 'luma444', '4:4:4', 4, 4), (1, 'luma422', '4:2:2', 2, 4), (2, 'luma420', '4:2:0', 2, 2)), s AS (SELECT n % 3 AS k, count(*) AS pictures, CAST(sum(w * h) AS BIGINT) AS pixels FROM pictures GROUP BY 1) SELECT level, label, samples, of_samples, pictures, pixels * samples // of_samples AS kept FROM t JOIN s USING (k)",
    "detect_format": f"WITH t(k, name, head) AS ({tables.sql_values([(k, *r) for k, r in enumerate(HEADS)])}), d AS (SELECT name, head || hex(coalesce(text, '')) AS h FROM documents JOIN t ON k = doc_id % {len(HEADS)}) SELECT name, {_detect_sql('h')} AS format, count(*) AS files, CAST(sum(length(h)) // 2 AS BIGINT) AS bytes FROM d GROUP BY ALL",
    "sniff_documents": "SELECT 'not_an_image' AS format, count(*) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents",
    "extension_filter": f"""WITH t AS ({_NAME_ROWS}), e AS (SELECT name, files, {_EXT} AS ext FROM t), f AS (SELECT name, files, CASE WHEN ext IN ('jpg', 'jpeg', 'jpe') THEN 'jpeg' WHEN ext IN ('tif', 'tiff') THEN 'tiff' WHEN ext IN ('png', 'webp', 'gif', 'bmp', 'ico', 'avif', 'heic', 'heif') THEN ext END AS format FROM e)
        SELECT name, format IS NOT NULL AS listed, format, files FROM f""",
    "sanitise_names": _names_sql(_NAME_ROWS, "name", f"name, stem, component, {_RESERVED_SQL.format('name')} AS reserved, files"),
    "sanitise_pages": _names_sql("SELECT page_id, url FROM pages", "url", "page_id, stem || '.webp' AS output_name, component"),
    "limits_classify": f"""WITH {PICTURES}, l(profile, b, p, s) AS ({tables.sql_values(tables.LIMITS)}), x AS (SELECT profile, n, w * 3 AS w, h * 3 AS h, p, s FROM pictures, l)
        SELECT profile, {_LIMIT_SQL.format('', '')} AS still, {_LIMIT_SQL.format('', '4 * ')} AS streamed, {_LIMIT_SQL.format(' * greatest(n, 1)', '')} AS animated, count(*) AS pictures FROM x GROUP BY 1, 2, 3, 4""",
    "sensitive_tags": f"WITH t(k, tag) AS ({tables.sql_values(list(enumerate(TAGS)))}) SELECT tag, regexp_matches(upper(tag), '^GPS|SERIAL|OWNER|ARTIST|COPYRIGHT|MAKERNOTE|LENS|BODY|THUMBNAIL') AS sensitive, count(*) AS photos FROM t JOIN orders ON o_orderkey % {len(TAGS)} = k GROUP BY ALL",
    "animation_decide": f"""WITH {PICTURES}, f(format, animated) AS ({tables.sql_values([(r[0], r[6]) for r in tables.FORMATS])}), p(policy) AS (VALUES ('keep'), ('first_frame')), c AS (SELECT n AS frames, count(*) AS pictures FROM pictures GROUP BY n),
        a AS (SELECT *, CASE WHEN frames <= 1 THEN 'still' WHEN animated THEN 'preserved' WHEN policy = 'first_frame' THEN 'flattened' ELSE 'refused' END AS action FROM c, f, p), o AS (SELECT *, CASE action WHEN 'preserved' THEN frames WHEN 'refused' THEN 0 ELSE least(frames, 1) END AS frames_out FROM a)
        SELECT format, policy, frames, action, frames_out, greatest(0, frames - frames_out) AS dropped, pictures FROM o""",
    "sandbox_classify": f"""WITH t(timed_out, stderr, code, signal) AS ({tables.sql_values(ENDS)}) SELECT timed_out, stderr, coalesce(CAST(code AS INTEGER), -1) AS code, coalesce(CAST(signal AS INTEGER), -1) AS signal, CASE WHEN timed_out THEN 'timed_out' WHEN contains(lower(stderr), 'memory allocation') OR contains(lower(stderr), 'out of memory') OR contains(lower(stderr), 'cannot allocate memory') THEN 'memory'
        WHEN code = 0 THEN 'ok' WHEN code = 2 THEN 'file_rejected' WHEN code = 4 THEN 'engine_failed' WHEN code = 5 THEN 'protocol_error' WHEN signal IS NOT NULL THEN 'memory' ELSE 'unexpected_status' END AS outcome FROM t""",
    "contract_drift": f"WITH a(type, field, kind) AS ({tables.sql_values(CONTRACT)}), b(type, field, kind) AS ({tables.sql_values(SEEN)}) SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM b EXCEPT SELECT * FROM a) y",
    "bench_gate": f"WITH t(bench, baseline_ms, mean_ms) AS ({tables.sql_values(RUNS)}) SELECT bench, round((mean_ms / baseline_ms - 1) * 100, 4) AS change_percent, CASE WHEN baseline_ms < 1 THEN 'advisory' WHEN (mean_ms / baseline_ms - 1) * 100 > 15 THEN 'fail' ELSE 'pass' END AS verdict FROM t",
}
