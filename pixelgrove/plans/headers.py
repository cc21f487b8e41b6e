"""Queries of what files say before they are decoded: EXIF blocks and HEIF boxes, written from the orders by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import exif, heif
from ..sources.splice import jpeg_with_exif
from .carriers import table


def _raw(*values: int) -> Column:
    return F.lit(bytes(values))


def _number(value: Column | int, size: int, order: str = ">") -> Column:
    """A number as bytes, by the order of the file."""
    if isinstance(value, int):
        return F.lit(value.to_bytes(size, "little" if order == "<" else "big"))
    digits = F.lpad(F.hex(value), 2 * size, "0")
    places = range(size) if order == ">" else reversed(range(size))
    return F.unhex(F.concat(*[F.substring(digits, 1 + 2 * k, 2) for k in places]))


def _text(value: Column) -> Column:
    return F.concat(F.encode(value, "UTF-8"), _raw(0))


def _tiff(key: Column, customer: Column, day: Column, order: str) -> Column:
    """A block of a main, an EXIF and a GPS directory at places that are the same in every file; the last is empty for two of three."""
    n = lambda v, size=4: _number(v, size, order)
    entry = lambda tag, kind, count, value: F.concat(n(tag, 2), n(kind, 2), n(count), value)
    model = F.when(key % 5 == 0, "Custome").otherwise(F.concat(F.lit("PX-"), F.lpad((key % 10_000).cast("string"), 4, "0")))
    main = F.concat(
        n(6, 2), entry(0x010F, 2, 16, n(86)), entry(0x0110, 2, 8, n(102)), entry(0x0112, 3, 1, F.concat(n(1 + key % 8, 2), n(0, 2))), entry(0x011A, 5, 1, n(110)), entry(0x8769, 4, 1, n(118)), entry(0x8825, 4, 1, n(200)), n(0),
        _text(F.concat(F.lit("Customer#"), F.lpad((customer % 1_000_000).cast("string"), 6, "0"))), _text(model), n(key), n(4),
    )
    more = F.concat(
        n(3, 2), entry(0x829A, 5, 1, n(160)), entry(0x9003, 2, 20, n(168)), entry(0xA431, 2, 11, n(188)), n(0),
        n(1), n(1 + key % 500), _text(F.date_format(day, "yyyy:MM:dd HH:mm:ss")), _text(F.lpad(key.cast("string"), 10, "0")), _raw(0),
    )
    place = F.concat(
        n(F.when(key % 3 == 0, 2).otherwise(0), 2), entry(1, 2, 2, F.concat(F.when(key % 2 == 0, F.lit(b"N")).otherwise(F.lit(b"S")), _raw(0, 0, 0))), entry(2, 5, 3, n(230)), n(0),
        n(key % 90), n(1), n(key % 60), n(1), n(key % 240), n(4),
    )
    return F.concat(F.lit(b"II*\0" if order == "<" else b"MM\0*"), n(8), main, more, place)


def _photos(spark, sf_dir):
    """id, content: a file for each order, by turns JPEG, PNG, WebP and TIFF; the block of every 11th is cut."""
    key, customer, day = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    whole = F.when(F.floor(key / 4) % 2 == 0, _tiff(key, customer, day, "<")).otherwise(_tiff(key, customer, day, ">"))
    df = table(spark, sf_dir, "orders").select(key.alias("id"), whole.alias("tiff"))
    tiff = F.when(F.col("id") % 11 == 0, F.expr("substring(tiff, 1, 180)")).otherwise(F.col("tiff"))
    df = df.select("id", tiff.alias("tiff"))
    tiff, size, turn = F.col("tiff"), F.octet_length("tiff"), F.col("id") % 4
    png = F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), _number(size, 4), F.lit(b"eXIf"), tiff, _raw(0, 0, 0, 0))
    webp = F.concat(F.lit(b"RIFF"), _number(12 + size, 4, "<"), F.lit(b"WEBPEXIF"), _number(size, 4, "<"), tiff)
    return df.select("id", F.when(turn == 0, jpeg_with_exif(F.lit(b"\xff\xd8\xff\xd9"), tiff)).when(turn == 1, png).when(turn == 2, webp).otherwise(tiff).alias("content"))


def exif_entries(spark, sf_dir):
    """Every entry of every photo."""
    return exif.entry_rows(_photos(spark, sf_dir)).select("id", "ordinal", "directory", "tag", "value")


def exif_summary(spark, sf_dir):
    """What each photo's entries come to."""
    df = exif.with_exif(_photos(spark, sf_dir))
    found = exif.summary(F.col("exif.entries"))
    return df.select("id", *[(F.array_join(c, ",") if n == "sensitive_tags" else c).alias(n) for n, c in found.items()], F.col("exif.problem").isNotNull().alias("damaged"))


def _part(data: bytes | Column, size: int | None = None) -> tuple[Column, Column | int]:
    """Bytes with their number, which is known before they are made."""
    return (F.lit(data), len(data)) if isinstance(data, bytes) else (data, size)


def _either(condition: Column, a: tuple, b: tuple) -> tuple:
    same = isinstance(a[1], int) and isinstance(b[1], int) and a[1] == b[1]
    return F.when(condition, a[0]).otherwise(b[0]), a[1] if same else F.when(condition, a[1]).otherwise(b[1])


def _box(name: str, *parts: tuple) -> tuple:
    """A box of parts. Its length comes from theirs, not from its content, which would be made once more at each level."""
    size = 8 + sum(n for _, n in parts if isinstance(n, int))
    for n in (n for _, n in parts if not isinstance(n, int)):
        size = n + size
    return F.concat(_number(size, 4), F.lit(name.encode()), *[c for c, _ in parts]), size


def _heifs(spark, sf_dir):
    """id, content: a HEIF file's metadata for each order.

    Every fifth is cut to half its sides, all are turned by a number of quarters, every seventh is coded otherwise,
    every third is described by EXIF; every 11th ends within its list of items.
    """
    key, zero, none = F.col("o_orderkey"), _part(bytes(4)), _part(b"")
    w, h = 1 + key * 37 % 8000, 1 + F.col("o_custkey") * 7919 % 6000
    other, described, clipped, even = key % 7 == 0, key % 3 == 1, key % 5 == 0, key % 2 == 0
    four = lambda value: (_number(value, 4), 4)
    infe = lambda item, kind: _box("infe", _part(bytes([2, 0, 0, 0, 0, item, 0, 0])), kind, _part(b"\0"))
    iinf = _box("iinf", zero, _either(described, _part(b"\0\2"), _part(b"\0\1")), infe(1, _either(other, _part(b"av01"), _part(b"hvc1"))), _either(described, infe(2, _part(b"Exif")), none))
    iref = _either(described, _box("iref", zero, _box("cdsc", _part(bytes([0, 2, 0, 1, 0, 1])))), none)
    hvc = _box("hvcC", _part(bytes(17)), _either(even, _part(b"\xf8"), _part(b"\xfa")), _part(bytes(5)))
    coded = _either(other, _box("av1C", _part(b"\x81\0"), _either(even, _part(b"\0"), _part(b"\x40")), _part(b"\0")), hvc)
    half = lambda side: F.floor((side + 1) / 2).cast("long")
    clap = _box("clap", four(half(w)), four(1), four(half(h)), four(1), _part(bytes(16)))
    ipco = _box("ipco", _box("ispe", zero, four(w), four(h)), coded, clap, _box("irot", (_number(key % 4, 1), 1)))
    ipma = _box("ipma", zero, four(1), _part(b"\0\1"), _either(clipped, _part(b"\4\x81\x82\x83\x84"), _part(b"\3\x81\x82\x84")))
    meta = _box("meta", zero, _box("pitm", zero, _part(b"\0\1")), iinf, iref, _box("iprp", ipco, ipma))
    ftyp = _box("ftyp", _part(b"heic"), zero, _part(b"mif1heic"))
    df = table(spark, sf_dir, "orders").select(key.alias("id"), F.concat(ftyp[0], meta[0]).alias("content"))
    return df.withColumn("content", F.when(F.col("id") % 11 == 0, F.expr("substring(content, 1, 60)")).otherwise(F.col("content")))


def heif_headers(spark, sf_dir):
    """Each file's primary picture."""
    df = heif.with_heif(_heifs(spark, sf_dir))
    return df.select("id", *[F.col(f"heif.{c}").alias(c) for c in ("width", "height", "coded_width", "coded_height", "bit_depth", "has_exif", "item_type", "error")])


def heif_boxes(spark, sf_dir):
    """How many boxes of each kind and place there are, and their bytes."""
    rows = heif.box_rows(_heifs(spark, sf_dir))
    return rows.groupBy("path", "cut").agg(F.count("*").alias("boxes"), F.sum("bytes").alias("bytes"), F.countDistinct("id").alias("files"))


_PHOTOS = """p AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderdate AS day, o_orderkey % 3 = 0 AS gps FROM orders WHERE o_orderkey % 11 <> 0),
    q AS (SELECT *, 'Customer#' || lpad(CAST(c % 1000000 AS VARCHAR), 6, '0') AS make, CASE WHEN id % 5 = 0 THEN 'Custome' ELSE 'PX-' || lpad(CAST(id % 10000 AS VARCHAR), 4, '0') END AS model, strftime(day, '%Y:%m:%d %H:%M:%S') AS taken FROM p)"""
_QUARTERS = "regexp_replace(CAST({0} / 4.0e0 AS VARCHAR), '\\.0$', '')"
_WHOLE = "o_orderkey % 11 <> 0"

QUERIES = {"exif_entries": exif_entries, "exif_summary": exif_summary, "heif_headers": heif_headers, "heif_boxes": heif_boxes}
SQL = {
    "exif_entries": f"""WITH {_PHOTOS}, e(id, ordinal, directory, tag, value) AS (
        SELECT id, 0, 'primary', 'Make', make FROM q UNION ALL SELECT id, 1, 'primary', 'Model', model FROM q UNION ALL SELECT id, 2, 'primary', 'Orientation', CAST(1 + id % 8 AS VARCHAR) FROM q
        UNION ALL SELECT id, 3, 'primary', 'XResolution', {_QUARTERS.format('id')} FROM q UNION ALL SELECT id, 4, 'exif', 'ExposureTime', '1/' || CAST(1 + id % 500 AS VARCHAR) FROM q
        UNION ALL SELECT id, 5, 'exif', 'DateTimeOriginal', taken FROM q UNION ALL SELECT id, 6, 'exif', 'BodySerialNumber', lpad(CAST(id AS VARCHAR), 10, '0') FROM q
        UNION ALL SELECT id, 7, 'gps', 'GPSLatitudeRef', CASE WHEN id % 2 = 0 THEN 'N' ELSE 'S' END FROM q WHERE gps
        UNION ALL SELECT id, 8, 'gps', 'GPSLatitude', CAST(id % 90 AS VARCHAR) || ' deg ' || CAST(id % 60 AS VARCHAR) || ' min ' || {_QUARTERS.format('(id % 240)')} || ' sec' FROM q WHERE gps)
        SELECT id, CAST(ordinal AS INTEGER) AS ordinal, directory, tag, value FROM e""",
    "exif_summary": f"""WITH {_PHOTOS} SELECT o.o_orderkey AS id, q.id IS NOT NULL AS has_exif, coalesce(gps, false) AS has_gps, CAST(1 + q.id % 8 AS INTEGER) AS orientation, CASE WHEN q.id % 5 = 0 THEN make ELSE make || ' ' || model END AS camera,
        taken AS captured_at, CASE WHEN q.id IS NULL THEN '' WHEN gps THEN 'BodySerialNumber,GPSLatitudeRef,GPSLatitude' ELSE 'BodySerialNumber' END AS sensitive_tags, q.id IS NULL AS damaged FROM orders o LEFT JOIN q ON q.id = o.o_orderkey""",
    "heif_headers": """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 11 <> 0 AS ok, 1 + o_orderkey * 37 % 8000 AS w, 1 + o_custkey * 7919 % 6000 AS h FROM orders),
        b AS (SELECT *, CASE WHEN id % 5 = 0 THEN (w + 1) // 2 ELSE w END AS cw, CASE WHEN id % 5 = 0 THEN (h + 1) // 2 ELSE h END AS ch FROM a)
        SELECT id, CASE WHEN ok THEN CASE WHEN id % 2 = 1 THEN ch ELSE cw END END AS width, CASE WHEN ok THEN CASE WHEN id % 2 = 1 THEN cw ELSE ch END END AS height, CASE WHEN ok THEN w END AS coded_width, CASE WHEN ok THEN h END AS coded_height,
        CASE WHEN ok THEN CAST(8 + 2 * (id % 2) AS INTEGER) END AS bit_depth, CASE WHEN ok THEN id % 3 = 1 END AS has_exif, CASE WHEN ok THEN CASE WHEN id % 7 = 0 THEN 'av01' ELSE 'hvc1' END END AS item_type,
        CASE WHEN NOT ok THEN 'heic_rejected' WHEN id % 7 = 0 THEN 'unsupported_coding' END AS error FROM b""",
    "heif_boxes": f"""WITH a AS (SELECT o_orderkey AS id, {_WHOLE} AS ok, o_orderkey % 3 = 1 AS e, o_orderkey % 7 = 0 AS av, o_orderkey % 5 = 0 AS cl FROM orders), s AS (SELECT *, CASE WHEN e THEN 56 ELSE 35 END AS iinf, CASE WHEN e THEN 26 ELSE 0 END AS iref, CASE WHEN av THEN 12 ELSE 31 END AS coded, CASE WHEN cl THEN 23 ELSE 22 END AS ipma FROM a),
        r(id, path, cut, bytes) AS (SELECT id, '/ftyp', false, 24 FROM s UNION ALL SELECT id, '/meta/pitm', false, 14 FROM s
        UNION ALL SELECT id, '/meta', NOT ok, CASE WHEN ok THEN 12 + 14 + iinf + iref + 8 + 8 + 20 + coded + 40 + 9 + ipma ELSE 36 END FROM s UNION ALL SELECT id, '/meta/iinf', NOT ok, CASE WHEN ok THEN iinf ELSE 10 END FROM s
        UNION ALL SELECT id, '/meta/iinf/infe', false, 21 FROM s WHERE ok UNION ALL SELECT id, '/meta/iinf/infe', false, 21 FROM s WHERE ok AND e UNION ALL SELECT id, '/meta/iref', false, 26 FROM s WHERE ok AND e UNION ALL SELECT id, '/meta/iref/cdsc', false, 14 FROM s WHERE ok AND e
        UNION ALL SELECT id, '/meta/iprp', false, 8 + 8 + 20 + coded + 40 + 9 + ipma FROM s WHERE ok UNION ALL SELECT id, '/meta/iprp/ipco', false, 8 + 20 + coded + 40 + 9 FROM s WHERE ok UNION ALL SELECT id, '/meta/iprp/ipma', false, ipma FROM s WHERE ok
        UNION ALL SELECT id, '/meta/iprp/ipco/ispe', false, 20 FROM s WHERE ok UNION ALL SELECT id, CASE WHEN av THEN '/meta/iprp/ipco/av1C' ELSE '/meta/iprp/ipco/hvcC' END, false, coded FROM s WHERE ok
        UNION ALL SELECT id, '/meta/iprp/ipco/clap', false, 40 FROM s WHERE ok UNION ALL SELECT id, '/meta/iprp/ipco/irot', false, 9 FROM s WHERE ok)
        SELECT path, cut, count(*) AS boxes, CAST(sum(bytes) AS BIGINT) AS bytes, count(DISTINCT id) AS files FROM r GROUP BY path, cut""",
}
