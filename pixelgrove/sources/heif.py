"""HEIF files by their boxes: every box as a row, and what the primary picture says about itself. No pixel is decoded.

A box is a length, a name of four letters and its content; some hold boxes. Lengths are not trusted: a box ends where the
one around it does, so files that are cut end without an error, and what is missing then is null.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Boxes that hold boxes, with the bytes in front of these; None where a version says how many.
HOLDERS = {b"meta": 4, b"iprp": 0, b"ipco": 0, b"iref": 4, b"iinf": None}
# Item types whose pictures are coded by HEVC, or laid out from such.
HEVC_ITEMS = (b"hvc1", b"grid", b"iden", b"iovl")
#: Levels that are entered; real files have four.
MOST_LEVELS = 8
#: Rows that leave a task at a time.
_BATCH_ROWS = 65_536


def _number(data: bytes, at: int, size: int) -> int:
    if at + size > len(data):
        raise ValueError("a number is cut off")
    return int.from_bytes(data[at : at + size], "big")


def boxes(data: bytes, start: int = 0, end: int | None = None, path: str = "") -> Iterator[tuple[str, int, int, int, bool]]:
    """(path, place, place of its content, end, cut) of each box, those it holds right behind it; an impossible length ends its level."""
    at, end = start, len(data) if end is None else end
    while at + 8 <= end:
        size, name, body = _number(data, at, 4), data[at + 4 : at + 8], at + 8
        if size == 1 and at + 16 <= end:
            size, body = _number(data, at + 8, 8), at + 16
        size = size or end - at
        if size < body - at:
            return
        stop = min(at + size, end)
        own = f"{path}/{name.decode('latin-1')}"
        yield own, at, body, stop, at + size > end
        if name in HOLDERS and own.count("/") < MOST_LEVELS:
            skip = HOLDERS[name]
            if skip is None:
                skip = 8 if data[body : body + 1] not in (b"", b"\0") else 6
            yield from boxes(data, body + skip, stop, own)
        at += size


def _associations(data: bytes, body: int) -> dict[int, list[int]]:
    """item -> its properties by number, in their order."""
    wide_id, wide = 4 if data[body] else 2, 2 if data[body + 3] & 1 else 1
    out, at = {}, body + 8
    for _ in range(_number(data, body + 4, 4)):
        item, n = _number(data, at, wide_id), _number(data, at + wide_id, 1)
        at += wide_id + 1
        out.setdefault(item, []).extend(_number(data, at + wide * k, wide) & ((1 << 8 * wide - 1) - 1) for k in range(n))
        at += wide * n
    return out


class Items:
    """What the boxes of a file say of its items: types, references, properties, the primary one."""

    def __init__(self, data: bytes):
        self.data, self.types, self.references, self.properties, self.of = data, {}, [], [], {}
        self.primary = self.places = self.held = None
        for path, _, body, end, short in boxes(data):
            name = path.rpartition("/")[2]
            if path == "/meta/pitm":
                self.primary = _number(data, body + 4, 4 if data[body] else 2)
            elif path == "/meta/iinf/infe" and data[body] >= 2:
                wide = 2 if data[body] == 2 else 4
                self.types[_number(data, body + 4, wide)] = data[body + 6 + wide : body + 10 + wide]
            elif path.startswith("/meta/iref/"):
                wide = self._wide
                n = _number(data, body + wide, 2)
                self.references.append((name, _number(data, body, wide), [_number(data, body + wide + 2 + wide * k, wide) for k in range(n)]))
            elif path == "/meta/iref":
                self._wide = 4 if data[body] else 2
            elif path.startswith("/meta/iprp/ipco/"):
                self.properties.append((name, body, end, short))
            elif path == "/meta/iprp/ipma":
                for item, found in _associations(data, body).items():
                    self.of.setdefault(item, []).extend(found)
            elif path == "/meta/iloc":
                self.places = body
            elif path == "/meta/idat":
                self.held = body

    def properties_of(self, item: int) -> list[tuple[str, int, int, bool]]:
        return [self.properties[k - 1] for k in self.of.get(item, ()) if 0 < k <= len(self.properties)]

    def described_by(self, kind: bytes, item: int) -> list[int]:
        """Items of a type that describe another one."""
        return [a for name, a, to in self.references if name == "cdsc" and item in to and self.types.get(a) == kind]

    def content(self, item: int) -> bytes:
        """The item's bytes, its extents joined."""
        d, at = self.data, self.places
        if at is None:
            return b""
        version, sizes, more = d[at], _number(d, at + 4, 1), _number(d, at + 5, 1)
        wide, base_size, index_size = (sizes >> 4, sizes & 15), more >> 4, more & 15 if version else 0
        id_size = 4 if version == 2 else 2
        n, at = _number(d, at + 6, id_size), at + 6 + id_size
        for _ in range(n):
            own, at = _number(d, at, id_size), at + id_size
            method = 0
            if version:
                method, at = _number(d, at, 2) & 15, at + 2
            base, extents = _number(d, at + 2, base_size), _number(d, at + 2 + base_size, 2)
            at += 4 + base_size
            step = index_size + sum(wide)
            if own == item:
                start = base + ((self.held or 0) if method == 1 else 0)
                found = [(_number(d, at + step * k + index_size, wide[0]), _number(d, at + step * k + index_size + wide[0], wide[1])) for k in range(extents)]
                if sum(size for _, size in found) > len(d):
                    raise ValueError("extents overlap")
                return b"".join(d[start + o : start + o + size] for o, size in found)
            at += step * extents
        return b""


def _depth(items: Items, item: int) -> int | None:
    """Bits of brightness, by the coding's own settings first."""
    found, d = {p[0]: p[1] for p in items.properties_of(item)}, items.data
    if "hvcC" in found:
        return 8 + (_number(d, found["hvcC"] + 17, 1) & 7)
    if "av1C" in found:
        flags = _number(d, found["av1C"] + 2, 1)
        return 12 if flags & 32 else 10 if flags & 64 else 8
    if "pixi" in found:
        return _number(d, found["pixi"] + 5, 1)
    return None


def header(data: bytes) -> dict:
    """width, height, coded_width, coded_height, bit_depth, has_exif, item_type, error, detail of the primary picture.

    The size is the one a viewer gets: properties that crop, turn and mirror are applied in the order they are listed. A
    file without a primary picture or its size is ``heic_rejected`` with the box that is missing; one that is not coded by
    HEVC has its fields and ``unsupported_coding``. A grid has its bit depth from its first tile where it has none.
    """
    out = dict.fromkeys(("width", "height", "coded_width", "coded_height", "bit_depth", "has_exif", "item_type", "error", "detail"))
    reject = lambda detail: out | {"error": "heic_rejected", "detail": detail}
    if data[4:8] != b"ftyp":
        return reject("ftyp: this is not a HEIF file")
    try:
        items = Items(data)
        if items.primary is None:
            return reject("pitm: no primary picture")
        kind, found = items.types.get(items.primary), items.properties_of(items.primary)
        if kind is None:
            return reject("infe: the primary picture has no entry")
        places = [p[1] for p in found if p[0] == "ispe"]
        if not places:
            return reject("ispe: the primary picture has no size")
        w, h = (_number(data, places[0] + 4 + 4 * k, 4) for k in range(2))
        out |= {"coded_width": w, "coded_height": h}
        for name, body, _, _ in found:
            if name == "clap":
                a = struct.unpack_from(">4I", data, body)
                if not a[1] or not a[3] or a[0] // a[1] > w or a[2] // a[3] > h:
                    return reject("clap: the cut is larger than the picture")
                w, h = a[0] // a[1], a[2] // a[3]
            elif name == "irot" and _number(data, body, 1) & 1:
                w, h = h, w
        tiles = next((to for name, a, to in items.references if name == "dimg" and a == items.primary), [])
        depth = _depth(items, items.primary)
        depth = _depth(items, tiles[0]) if depth is None and tiles else depth
        out |= {"width": w, "height": h, "bit_depth": depth, "has_exif": bool(items.described_by(b"Exif", items.primary)), "item_type": kind.decode("latin-1")}
        return out if kind in HEVC_ITEMS else out | {"error": "unsupported_coding"}
    except (ValueError, IndexError, struct.error) as e:
        return dict.fromkeys(out) | {"error": "heic_rejected", "detail": f"meta: {e}"}


def exif_block(data: bytes) -> bytes:
    """The TIFF block that describes the primary picture; empty if there is none or the boxes are damaged."""
    try:
        items = Items(data)
        found = items.described_by(b"Exif", items.primary) if items.primary is not None else []
        raw = items.content(found[0]) if found else b""
        return raw[4 + _number(raw, 0, 4) :] if len(raw) > 4 else b""
    except (ValueError, IndexError):
        return b""


def box_rows(files: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """key, ordinal, path, start, bytes, cut: each box of each file. Files that do not begin with a box have no rows, nor have nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        frame = lambda: pd.DataFrame(rows, columns=[key, "ordinal", "path", "start", "bytes", "cut"])
        for b in batches:
            for k, data in zip(b[key], b[content], strict=True):
                if data is None or data[4:8] != b"ftyp":
                    continue
                for n, (path, at, _, end, short) in enumerate(boxes(data)):
                    rows.append((k, n, path, at, end - at, short))
                    if len(rows) >= _BATCH_ROWS:
                        yield frame()
                        rows = []
        if rows:
            yield frame()

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, content).mapInPandas(run, f"{key} {kind}, ordinal long, path string, start long, bytes long, cut boolean")


def with_heif(df: DataFrame, content: str = "content") -> DataFrame:
    """df with ``heif``, the struct of :func:`header`; null where the content is no HEIF file."""

    @F.pandas_udf("width long, height long, coded_width long, coded_height long, bit_depth int, has_exif boolean, item_type string, error string, detail string")
    def read(c: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([header(x or b"") for x in c], columns=["width", "height", "coded_width", "coded_height", "bit_depth", "has_exif", "item_type", "error", "detail"])
        numbers = {n: out[n].astype("Int64") for n in ("width", "height", "coded_width", "coded_height", "bit_depth")}
        return out.assign(**numbers, has_exif=out["has_exif"].astype("boolean"))

    is_heif = F.coalesce(F.substring(content, 5, 4) == F.lit(b"ftyp"), F.lit(False))
    return df.withColumn("heif", F.when(is_heif, read(content)))
