"""EXIF as a table: one row for each entry of a file's directories, whatever container holds the block.

JPEG has it in a segment, PNG in ``eXIf``, WebP in ``EXIF``, HEIF in an item; a TIFF file is one. A small helper walks the
directories of a file; files are spread by Spark, in Arrow batches, and what is asked of the entries are column expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates
from .headers import _segments
from .heif import exif_block
from .profiles import _chunks

# Tags of the main and the EXIF directory by number.
TAGS = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model",
    0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel", 0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration",
    0x0128: "ResolutionUnit", 0x012D: "TransferFunction", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013E: "WhitePoint", 0x013F: "PrimaryChromaticities", 0x0201: "JPEGInterchangeFormat",
    0x0202: "JPEGInterchangeFormatLength", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling", 0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x829A: "ExposureTime",
    0x829D: "FNumber", 0x8769: "ExifPointer", 0x8822: "ExposureProgram", 0x8824: "SpectralSensitivity", 0x8825: "GPSPointer", 0x8827: "PhotographicSensitivity", 0x8828: "OECF", 0x8830: "SensitivityType",
    0x8831: "StandardOutputSensitivity", 0x8832: "RecommendedExposureIndex", 0x8833: "ISOSpeed", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime",
    0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized", 0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash", 0x920A: "FocalLength", 0x9214: "SubjectArea",
    0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubSecTime", 0x9291: "SubSecTimeOriginal", 0x9292: "SubSecTimeDigitized", 0xA000: "FlashpixVersion", 0xA001: "ColorSpace", 0xA002: "PixelXDimension",
    0xA003: "PixelYDimension", 0xA004: "RelatedSoundFile", 0xA005: "InteropPointer", 0xA20B: "FlashEnergy", 0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit",
    0xA214: "SubjectLocation", 0xA215: "ExposureIndex", 0xA217: "SensingMethod", 0xA300: "FileSource", 0xA301: "SceneType", 0xA302: "CFAPattern", 0xA401: "CustomRendered", 0xA402: "ExposureMode",
    0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio", 0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA407: "GainControl", 0xA408: "Contrast", 0xA409: "Saturation", 0xA40A: "Sharpness",
    0xA40B: "DeviceSettingDescription", 0xA40C: "SubjectDistanceRange", 0xA420: "ImageUniqueID", 0xA430: "CameraOwnerName", 0xA431: "BodySerialNumber", 0xA432: "LensSpecification", 0xA433: "LensMake",
    0xA434: "LensModel", 0xA435: "LensSerialNumber", 0xA500: "Gamma",
}
# Tags of the GPS directory, by number from 0.
GPS_TAGS = dict(enumerate(
    "GPSVersionID GPSLatitudeRef GPSLatitude GPSLongitudeRef GPSLongitude GPSAltitudeRef GPSAltitude GPSTimeStamp GPSSatellites GPSStatus GPSMeasureMode GPSDOP GPSSpeedRef GPSSpeed GPSTrackRef GPSTrack GPSImgDirectionRef "
    "GPSImgDirection GPSMapDatum GPSDestLatitudeRef GPSDestLatitude GPSDestLongitudeRef GPSDestLongitude GPSDestBearingRef GPSDestBearing GPSDestDistanceRef GPSDestDistance GPSProcessingMethod GPSAreaInformation GPSDateStamp "
    "GPSDifferential GPSHPositioningError".split()
))
# Tags of the interoperability directory.
INTEROP_TAGS = {1: "InteroperabilityIndex", 2: "InteroperabilityVersion"}
# Tags that tell where a picture was taken.
PLACES = ("GPSLatitude", "GPSLatitudeRef", "GPSLongitude", "GPSLongitudeRef", "GPSAltitude")
# Kinds of values: code of a number, bytes.
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("x", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4)}
_POINTERS = {0x8769: "exif", 0x8825: "gps", 0xA005: "interop"}
_NAMES = {"gps": GPS_TAGS, "interop": INTEROP_TAGS}
#: What is undefined and longer than this is told by its length.
MOST_UNDEFINED = 4096


def block(data: bytes) -> bytes:
    """The TIFF block of a file; empty if it has none."""
    if data[:2] == b"\xff\xd8":
        return next((data[a + 6 : b] for marker, a, b in _segments(data) if marker == 0xE1 and data[a : a + 6] == b"Exif\0\0"), b"")
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return next((body for name, body in _chunks(data, 8, ">", False, False) if name == b"eXIf"), b"")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return next((body.removeprefix(b"Exif\0\0") for name, body in _chunks(data, 12, "<", True, True) if name == b"EXIF"), b"")
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    return exif_block(data) if data[4:8] == b"ftyp" else b""


def _plain(x: float) -> str:
    return repr(x).removesuffix(".0")


def _text(tag: str, kind: int, count: int, raw: bytes, order: str) -> str:
    """A value as text: numbers by commas, fractions as decimals, angles by degree, what is undefined in hexadecimal."""
    if kind == 2:
        return ", ".join(filter(None, (p.decode("utf-8", "replace").strip() for p in raw.split(b"\0"))))
    if kind not in KINDS or (kind == 7 and count > MOST_UNDEFINED):
        return f"{len(raw)} bytes"
    if kind == 7:
        return "0x" + raw.hex() if raw else ""
    numbers = struct.unpack(order + KINDS[kind][0] * count, raw)
    if kind not in (5, 10):
        return ", ".join(_plain(x) if isinstance(x, float) else str(x) for x in numbers)
    pairs = list(zip(numbers[::2], numbers[1::2], strict=True))
    whole = [f"{n}/0" if not d else _plain(n / d) for n, d in pairs]
    if tag.endswith(("Latitude", "Longitude")) and count == 3:
        return " ".join(f"{x} {unit}" for x, unit in zip(whole, ("deg", "min", "sec"), strict=True))
    if tag == "ExposureTime":
        return ", ".join(f"{n}/{d}" for n, d in pairs)
    return ", ".join(whole)


def entries(tiff: bytes) -> list[tuple[str, int, str, str]]:
    """(directory, number, tag, value) of a TIFF block, in their order, pointers followed where they stand; ValueError if it is damaged.

    A directory is read once, however many pointers lead to it. Entries with no value are left out, tags without a name are
    called by number. Kinds without a size are told by four bytes. Values may share bytes, but a block whose values are
    together much longer than itself is damaged: so the entries of a file are bounded by its size.
    """
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        raise ValueError("no TIFF header")
    out, seen, todo, left = [], set(), [("primary", struct.unpack_from(order + "I", tiff, 4)[0], 0)], 4 * len(tiff)
    try:
        while todo:
            where, at, k = todo.pop()
            if k == 0:
                if at in seen or not at:
                    continue
                seen.add(at)
            n = struct.unpack_from(order + "H", tiff, at)[0]
            while k < n:
                number, kind, count = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
                place, size = at + 10 + 12 * k, KINDS[kind][1] * count if kind in KINDS else 4
                if size > 4:
                    place = struct.unpack_from(order + "I", tiff, place)[0]
                if place + size > len(tiff):
                    raise ValueError(f"a value of {where} is cut off")
                k, left = k + 1, left - size
                if left < 0:
                    raise ValueError("values overlap")
                if number in _POINTERS and where in ("primary", "thumbnail", "exif") and kind in (4, 13) and count:
                    todo += [(where, at, k), (_POINTERS[number], struct.unpack_from(order + "I", tiff, place)[0], 0)]
                    break
                tag = _NAMES.get(where, TAGS).get(number, f"0x{number:04x}")
                value = _text(tag, kind, count, tiff[place : place + size], order)
                if value:
                    out.append((where, number, tag, value))
            else:
                if where == "primary":
                    todo.insert(0, ("thumbnail", struct.unpack_from(order + "I", tiff, at + 2 + 12 * n)[0], 0))
    except struct.error:
        raise ValueError(f"directory {where} is cut off") from None
    return out


def with_exif(df: DataFrame, content: str = "content") -> DataFrame:
    """df with ``exif``: struct(entries: array of (directory, number, tag, value), problem).

    entries is empty and problem null where a file has no block; a damaged block has no entries and a problem. Null contents have none.
    """

    @F.pandas_udf("entries array<struct<directory:string,number:int,tag:string,value:string>>, problem string")
    def read(c: pd.Series) -> pd.DataFrame:
        rows = []
        for data in c:
            found, problem = [], None
            try:
                tiff = block(data or b"")
                found = [dict(zip(("directory", "number", "tag", "value"), e, strict=True)) for e in (entries(tiff) if tiff else ())]
            except ValueError as e:
                problem = str(e)
            rows.append((found, problem))
        return pd.DataFrame(rows, columns=["entries", "problem"])

    return df.withColumn("exif", read(content))


def entry_rows(df: DataFrame, content: str = "content") -> DataFrame:
    """df without its content, a row for each EXIF entry: ordinal, directory, number, tag, value."""
    kept = [c for c in df.columns if c != content]
    # The outer form, as the plain one infers a filter on the entries, for which files would be made and read twice.
    each = with_exif(df, content).select(*kept, F.posexplode_outer("exif.entries").alias("ordinal", "e")).filter("ordinal IS NOT NULL")
    return each.select(*kept, "ordinal", "e.directory", "e.number", "e.tag", "e.value")


def summary(found: Column) -> dict[str, Column]:
    """What a file's entries come to: has_exif, has_gps, orientation, camera, captured_at, sensitive_tags, in the entries' order.

    camera joins maker and model, a value left out that is already within; captured_at is the last of two dates;
    orientation is the last one's number.
    """
    last = lambda keep: F.try_element_at(F.filter(found, keep), F.lit(-1))
    both = F.transform(F.filter(found, lambda e: e["tag"].isin("Make", "Model")), lambda e: e["value"])
    joined = F.aggregate(both, F.lit(None).cast("string"), lambda a, v: F.when(a.isNull(), v).when(a.contains(v), a).otherwise(F.concat_ws(" ", a, v)))
    return {
        "has_exif": F.coalesce(F.size(found) > 0, F.lit(False)), "has_gps": F.coalesce(F.exists(found, lambda e: e["tag"].isin(*PLACES)), F.lit(False)),
        "orientation": last(lambda e: e["tag"] == "Orientation")["value"].try_cast("int"), "camera": joined, "captured_at": last(lambda e: e["tag"].isin("DateTimeOriginal", "DateTime"))["value"],
        "sensitive_tags": F.transform(F.filter(found, lambda e: predicates.is_sensitive(e["tag"])), lambda e: e["tag"]),
    }
