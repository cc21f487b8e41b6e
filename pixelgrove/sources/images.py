"""Reading folders of pictures, and writing results."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import predicates, tables
from ..functions.names import file_name_of, output_name
from ..operators.batch import envelope, verdicts
from . import folders
from .folders import MOST_DEPTH
from .headers import header_size, header_sizes
from .profiles import read_profile

FILE_SCHEMA = StructType().add("path", "string").add("modificationTime", "timestamp").add("length", "long").add("content", "binary")


#: Files that a plan looks at.
MOST_ENTRIES = 10_000


def files(spark: SparkSession, roots: str | list[str], *, max_bytes: int | None = None) -> DataFrame:
    """ordinal-free rows of path, name, bytes, content below the roots; the ceiling is pushed to the scan."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    if max_bytes is not None:
        df = df.filter(F.col("length") <= max_bytes)
    return df.select("path", file_name_of(F.col("path")).alias("name"), F.col("length").alias("bytes"), "content")


def _below(spark: SparkSession, path: Column, roots: list[str]) -> Column:
    """The part of a path below its root."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    whole = [hadoop(r).getFileSystem(conf).makeQualified(hadoop(r)).toString().rstrip("/") + "/" for r in roots]
    out = file_name_of(path)
    for r in sorted(whole, key=len):
        out = F.when(path.startswith(r), F.substring(path, len(r) + 1, 1 << 30)).otherwise(out)
    return out


def _local(roots: list[str]) -> bool:
    return all(r.startswith("file:") or "://" not in r for r in roots)


def listing(spark: SparkSession, roots: str | list[str], depth: int = MOST_DEPTH) -> DataFrame:
    """path, name, bytes, depth, problem of every file that is not hidden below its root; no content is read.

    Folders that are mounted are walked by the library's own source, which leaves links out and says what it could
    not walk. Other stores are listed by Spark's binary source, which has neither links nor sentences.
    """
    roots = [roots] if isinstance(roots, str) else roots
    if _local(roots):
        whole = [folders.clean(r) for r in roots]
        return folders.tree(spark, whole, depth=depth).withColumn("path", F.concat(F.lit("file:"), "path"))
    df = files(spark, roots).drop("content")
    below = _below(spark, F.col("path"), roots)
    deep = F.when(F.col("depth") > depth, folders._DEEP.format(depth))
    return df.filter(~below.rlike(r"(^|/)\.")).withColumn("depth", F.size(F.split(below, "/"))).distinct().withColumn("problem", deep)


def folder_problems(spark: SparkSession, roots: str | list[str], *, entries: int = MOST_ENTRIES, depth: int = MOST_DEPTH) -> DataFrame:
    """problem, sentence, files: what a plan leaves out; a row for each path that was not walked, and one for files beyond the plan."""
    found = listing(spark, roots, depth)
    kind = F.when(F.col("problem").startswith("stopped "), "too_deep").when(F.col("problem").startswith("could not look"), "not_found").otherwise("not_opened")
    paths = found.filter("problem IS NOT NULL").groupBy(kind.alias("problem"), F.col("problem").alias("sentence")).agg(F.count("*").alias("files"))
    many = found.filter("problem IS NULL").agg((F.count("*") - entries).alias("files")).filter("files > 0")
    sentence = f"stopped after {entries} files; the rest of this folder was not looked at"
    return paths.unionByName(many.select(F.lit("too_many_entries").alias("problem"), F.lit(sentence).alias("sentence"), "files"))


def folder_plan(spark: SparkSession, roots: str | list[str], profile: str = "desktop", *, entries: int = MOST_ENTRIES, depth: int = MOST_DEPTH) -> DataFrame:
    """path, name, bytes, format, width, height, verdict, error, bytes_read of the first ``entries`` files by path below the roots.

    Files are listed without being opened. Only what the plan keeps, is named as a picture and is not too large is opened, for
    the 4,096 bytes that say its format and size; ``error`` says which limit that size breaks, before any pixel is
    decoded. Files in other stores than mounted folders are read whole for that, as Spark has no ranged read of them.
    """
    roots = [roots] if isinstance(roots, str) else roots
    _, max_bytes, max_pixels, max_side = next(r for r in tables.LIMITS if r[0] == profile)
    decodable = [r[0] for r in tables.FORMATS if r[8]]
    listed = predicates.has_image_extension(F.col("name"))
    plan = listing(spark, roots, depth).filter("problem IS NULL").orderBy("path").limit(entries).select("path", "name", "bytes", listed.alias("listed"))
    if _local(roots):
        plan = folders.heads(plan.repartition(2 * spark.sparkContext.defaultParallelism), F.col("listed") & (F.col("bytes") <= max_bytes))
        plan = plan.withColumn("format", predicates.detect_format(F.substring("head", 1, 64))).drop("head")
    else:
        heads = header_sizes(files(spark, roots, max_bytes=max_bytes).filter(listed)).select("path", predicates.detect_format(F.substring("content", 1, 64)).alias("format"), "width", "height", F.col("bytes").alias("bytes_read"))
        plan = plan.join(heads, "path", "left")
    plan = verdicts(plan.withColumn("can_decode", F.coalesce(F.col("format").isin(decodable), F.lit(False))), max_bytes).drop("listed", "can_decode")
    return plan.withColumn("error", F.when(F.col("verdict") == "ready", predicates.header_error(F.col("width"), F.col("height"), F.lit(max_pixels), F.lit(max_side))))


def decoded(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, width, height, channels, data of what Spark's image source can decode; others have width -1."""
    df = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(paths)
    # As the binary source writes it: not escaped (a plus stands for itself), one slash.
    path = F.regexp_replace(F.url_decode(F.replace("image.origin", F.lit("+"), F.lit("%2B"))), "^file:///", "file:/")
    return df.select(path.alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def gif_scan(data: bytes) -> tuple[int, bool]:
    """Frames of a GIF file, and whether it breaks off."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        return 0, True
    at, frames = 13 + (3 << (data[10] & 7) + 1 if data[10] & 0x80 else 0), 0

    def blocks(at: int) -> int:
        while at < len(data) and data[at]:
            at += data[at] + 1
        return at + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return frames, False
        if kind == 0x21:
            at = blocks(at + 2)
        elif kind == 0x2C:
            frames += 1  # a picture counts from its separator on, cut or not
            if at + 10 > len(data):
                return frames, True
            at = blocks(at + 10 + (3 << (data[at + 9] & 7) + 1 if data[at + 9] & 0x80 else 0) + 1)
        elif kind == 0:
            at += 1
        else:
            return frames, True
    return frames, True


def gif_frames(df: DataFrame, content: str = "content") -> DataFrame:
    """df with frames and truncated of GIF bytes: blocks are walked, nothing is decoded."""

    @F.pandas_udf("frames int, truncated boolean")
    def run(c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([gif_scan(x or b"") for x in c], columns=["frames", "truncated"])

    return df.withColumn("__scan", run(F.col(content))).select("*", "__scan.frames", "__scan.truncated").drop("__scan")


def heads(df: DataFrame, content: str = "content") -> DataFrame:
    """df with width, height, frames, truncated, icc_present, colour_space of files, read in one pass.

    Marked as not deterministic, so that a filter on what follows from heads stays above: below, files would be made and read again.
    """

    @F.pandas_udf("width long, height long, frames int, truncated boolean, icc_present boolean, colour_space string")
    def read(c: pd.Series) -> pd.DataFrame:
        rows = [(*(header_size(x or b"") or (None, None)), *gif_scan(x or b""), *read_profile(x)[:2]) for x in c]
        found = pd.DataFrame(rows, columns=["width", "height", "frames", "truncated", "icc_present", "colour_space"])
        return found.astype({"width": "Int64", "height": "Int64"})

    names = ("width", "height", "frames", "truncated", "icc_present", "colour_space")
    return df.withColumn("__heads", read.asNondeterministic()(F.col(content))).select("*", *[f"__heads.{n}" for n in names]).drop("__heads")


def zip_archives(outputs: DataFrame, batch: str = "batch") -> DataFrame:
    """One archive for each batch of (batch, ordinal, name, bytes) that the envelope lets pass.

    An archive is made in one task; the envelope's rules bound it (512 files, 16 MB). They are checked on sizes, before bytes are grouped.
    """
    sizes = outputs.select(batch, "ordinal", F.octet_length("bytes").alias("size"))
    passed = envelope(sizes, batch, "ordinal", "size").filter("violated IS NULL").select(batch)
    outputs = outputs.join(passed, batch, "left_semi")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for r in pdf.sort_values("ordinal").itertuples():
                info = zipfile.ZipInfo(r.name)
                info.compress_type, info.external_attr = zipfile.ZIP_DEFLATED, 0o644 << 16
                z.writestr(info, r.bytes)
        return pd.DataFrame({batch: [key[0]], "archive": [buffer.getvalue()], "entries": [len(pdf)]})

    kind = outputs.schema[batch].dataType.simpleString()
    return outputs.select(batch, "ordinal", "name", "bytes").groupBy(batch).applyInPandas(run, f"{batch} {kind}, archive binary, entries int")


def with_output_names(jobs: DataFrame, extension: str) -> DataFrame:
    return jobs.withColumn("output_name", output_name(F.col("name"), F.lit(extension)))


def requests(df: DataFrame, column: str = "json") -> DataFrame:
    """JSON requests with a picture in base64, as columns; what does not parse has a null request."""
    schema = "id string, name string, bytes string, width long, height long, fit string, format string, quality int"
    parsed = df.withColumn("request", F.from_json(column, schema))
    return parsed.select("request.id", "request.name", F.unbase64("request.bytes").alias("bytes"), "request.width", "request.height", F.coalesce("request.fit", F.lit("contain")).alias("fit"), F.coalesce("request.format", F.lit("jpeg")).alias("format"), F.coalesce("request.quality", F.lit(85)).alias("quality"))


