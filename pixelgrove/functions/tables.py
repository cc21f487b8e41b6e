"""Dimension tables: formats, chroma levels, limits and presets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Format, extension, mime, lossless, read_only, alpha, animation, icc, decodable here.
FORMATS = [
    ("jpeg", "jpg", "image/jpeg", False, False, False, False, True, True),
    ("png", "png", "image/png", True, False, True, False, True, True),
    ("webp", "webp", "image/webp", False, False, True, False, False, False),
    ("gif", "gif", "image/gif", True, False, True, True, False, True),
    ("tiff", "tiff", "image/tiff", True, False, False, False, False, True),
    ("bmp", "bmp", "image/bmp", True, False, False, False, False, True),
    ("ico", "ico", "image/x-icon", True, False, True, False, False, False),
    ("avif", "avif", "image/avif", False, False, False, False, False, False),
    ("heic", "heic", "image/heic", True, True, False, False, False, False),
    ("heif", "heif", "image/heif", True, True, False, False, False, False),
]
# File extensions of each format.
EXTENSIONS = {"jpg": "jpeg", "jpeg": "jpeg", "jpe": "jpeg", "png": "png", "webp": "webp", "gif": "gif", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "ico": "ico", "avif": "avif", "heic": "heic", "heif": "heif"}
# Level, label, chroma samples over those of 4:4:4.
CHROMA = [("luma444", "4:4:4", 4, 4), ("luma422", "4:2:2", 2, 4), ("luma420", "4:2:0", 2, 2)]
# Profile, bytes, pixels, side.
LIMITS = [("desktop", 512 << 20, 128_000_000, 30_000), ("mobile", 128 << 20, 40_000_000, 16_000)]
# Id, category, width, height, fit, format, quality, byte ceiling, crops.
PRESETS = [
    ("ig-post", "social", 1080, 1080, "cover", "jpeg", 85, 2097152, True), ("ig-portrait", "social", 1080, 1350, "cover", "jpeg", 85, 2093056, True), ("ig-story", "social", 1080, 1920, "cover", "jpeg", 82, 4194304, True),
    ("fb-link", "social", 1200, 628, "cover", "jpeg", 85, 1048576, True), ("x-post", "social", 1600, 900, "cover", "jpeg", 85, 1048576, True), ("yt-thumb", "social", 1280, 720, "cover", "jpeg", 88, 2097152, True),
    ("yt-thumb-hd", "social", 2560, 1440, "cover", "jpeg", 88, 2097152, True), ("li-cover", "social", 1584, 396, "cover", "jpeg", 88, 1048576, True), ("tt-post", "social", 1080, 1920, "cover", "jpeg", 82, 4194304, True),
    ("wa-status", "social", 1080, 1920, "contain", "jpeg", 82, 1048576, False), ("pin-standard", "social", 1000, 1500, "contain", "jpeg", 85, 2097152, False), ("discord-banner", "social", 960, 540, "cover", "jpeg", 85, 1048576, True),
    ("web-hero", "web", 1920, None, "width", "webp", 80, 358400, False), ("web-card", "web", 800, 450, "cover", "webp", 80, 122880, True), ("web-thumb", "web", 400, 300, "cover", "webp", 78, 61440, True),
    ("web-og", "web", 1200, 630, "cover", "jpeg", 85, 307200, True), ("web-srcset-1x", "web", 640, None, "width", "webp", 82, None, False), ("web-srcset-2x", "web", 1280, None, "width", "webp", 82, None, False),
    ("web-favicon", "web", 32, 32, "cover", "png", 100, 8192, True), ("web-pwa-192", "web", 192, 192, "cover", "png", 100, None, True), ("web-pwa-512", "web", 512, 512, "cover", "png", 100, None, True),
    ("print-a4-300", "print", 2480, 3508, "contain", "jpeg", 92, None, False), ("print-a4-150", "print", 1240, 1754, "contain", "jpeg", 90, None, False), ("print-letter-300", "print", 2550, 3300, "contain", "jpeg", 92, None, False),
    ("print-4x6-300", "print", 1200, 1800, "contain", "jpeg", 92, None, False), ("print-5x7-300", "print", 1500, 2100, "contain", "jpeg", 92, None, False), ("wall-1080", "device", 1080, 1920, "cover", "jpeg", 88, 4194304, True),
    ("wall-1440", "device", 1440, 2560, "cover", "jpeg", 88, 6291456, True), ("wall-tablet", "device", 2048, 1536, "cover", "jpeg", 88, 6291456, True), ("desktop-1080", "device", 1920, 1080, "cover", "jpeg", 88, None, True),
    ("desktop-4k", "device", 3840, 2160, "cover", "jpeg", 90, None, True), ("email-1mb", "email", 1600, None, "width", "jpeg", 0, 1048576, False), ("email-500k", "email", 1200, None, "width", "jpeg", 0, 512000, False),
    ("email-250k", "email", 900, None, "width", "jpeg", 0, 256000, False), ("android-mdpi", "developer", 48, 48, "contain", "png", 100, None, False), ("android-hdpi", "developer", 72, 72, "contain", "png", 100, None, False),
    ("android-xhdpi", "developer", 96, 96, "contain", "png", 100, None, False), ("android-xxhdpi", "developer", 144, 144, "contain", "png", 100, None, False), ("android-xxxhdpi", "developer", 192, 192, "contain", "png", 100, None, False),
    ("ios-appicon", "developer", 1024, 1024, "contain", "png", 100, None, False), ("store-screenshot", "developer", 1080, 1920, "contain", "jpeg", 90, 1048576, False),
]


def sql_values(rows: list[tuple]) -> str:
    """The rows as a SQL VALUES list."""
    one = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else f"{x!r}" + "e0" * ("e" not in repr(x)) if isinstance(x, float) else str(x)
    return "VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def formats(spark: SparkSession) -> DataFrame:
    """One row for each format, with the predicates that follow from others."""
    base = spark.createDataFrame([(i, *r) for i, r in enumerate(FORMATS)], "ordinal int, format string, extension string, mime string, lossless boolean, read_only boolean, supports_alpha boolean, supports_animation boolean, supports_icc boolean, can_decode boolean")
    return base.selectExpr("*", "format = 'jpeg' AS supports_progressive", "format = 'jpeg' AS supports_chroma", "NOT lossless AS supports_quality", "NOT lossless AS supports_byte_target", "supports_animation AS accepts_multiple_frames")


def chroma(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHROMA, "level string, label string, samples int, of_samples int")


def limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIMITS, "profile string, max_bytes long, max_pixels long, max_side long")


def find_preset(name: str) -> dict | None:
    """The preset of exactly this id, as a request, or None."""
    keys = ("preset", "category", "width", "height", "fit", "format", "quality", "max_bytes", "crops")
    row = next((r for r in PRESETS if r[0] == name), None)
    return None if row is None else dict(zip(keys, row, strict=True)) | {"no_upscale": not row[8] and row[1] != "social"}


def presets(spark: SparkSession) -> DataFrame:
    """The catalogue as requests: what neither crops nor is social keeps small pictures small."""
    base = spark.createDataFrame(PRESETS, "preset string, category string, width long, height long, fit string, format string, quality int, max_bytes long, crops boolean")
    return base.selectExpr("preset", "category", "width", "height", "fit", "format", "quality", "CASE WHEN format IN ('jpeg', 'webp', 'avif') THEN max_bytes END AS max_bytes", "crops", "NOT crops AND category <> 'social' AS no_upscale")
