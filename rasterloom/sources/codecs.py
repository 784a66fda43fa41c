"""Raster files without native libraries: TIFF and GeoTIFF, PNG, and images with a PDS4 label."""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np

from .sinks import png_bytes


class RasterError(Exception):
    """Any failure to read a raster."""


class UnsupportedFormat(RasterError):
    pass


class CorruptRaster(RasterError):
    pass


@dataclass
class Raster:
    """bands x height x width, and what the file says about it. geotransform: (c, a, b, f, d, e) with x = c + a col + b row, y = f + d col + e row."""

    data: np.ndarray
    crs: str | None = None
    geotransform: tuple[float, ...] | None = None
    nodata: float | None = None
    tags: dict[str, str] = field(default_factory=dict)


# Fixed values of the TIFF format: field types by number, and the tags that are used.
_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, MATRIX, GEO_KEYS, GEO_NUMBERS, GEO_TEXTS, METADATA, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE, ZSTD = 1, 5, 8, 32773, 32946, 50000
MODEL, RASTER, GEOGRAPHIC, GEOGRAPHIC_NAME, PROJECTED, PROJECTED_NAME = 1024, 1025, 2048, 2049, 3072, 3073
OWN_SYSTEM, PIXEL_IS_AREA = 32767, 1
#: What precedes a system's text in a name key, and the form in which other systems of a file are told.
TEXT_MARK, KEYS_MARK = "ESRI PE String = ", "GEOTIFF:"


def tiff_header(read) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags) of the first image of a TIFF or BigTIFF; ``read(offset, size)`` gives bytes."""
    head = read(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    kind = struct.unpack(order + "H", head[2:4])[0] if order and len(head) >= 8 else None
    if kind not in (42, 43) or (kind == 43 and len(head) < 16):
        raise CorruptRaster("no TIFF header")
    # Widths of the classic and of the big form: the first offset's place, the number of entries, an entry, its value.
    place, many, whole, word = (4, "H", 12, "I") if kind == 42 else (8, "Q", 20, "Q")
    width = struct.calcsize("=" + word)
    (at,) = struct.unpack(order + word, head[place: place + width])
    first = at + struct.calcsize("=" + many)
    (n,) = struct.unpack(order + many, read(at, struct.calcsize("=" + many)))
    if n > 65535:
        raise CorruptRaster(f"{n} tags")
    table, tags = read(first, n * whole), {}
    for k in range(n):
        entry = table[k * whole: (k + 1) * whole]
        tag, kind, count = struct.unpack(order + "HH" + word, entry[: 4 + width])
        if kind not in _TYPES:
            continue
        code, value = _TYPES[kind], entry[4 + width:]
        size = (1 if code == "s" else struct.calcsize("=" + code)) * count
        raw = value[:size] if size <= width else read(struct.unpack(order + word, value)[0], size)
        if len(raw) < size:
            raise CorruptRaster("tags are cut short")
        tags[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", raw)
    for needed in (WIDTH, HEIGHT):
        if needed not in tags:
            raise CorruptRaster("no image size")
    return order, tags


def _dtype(order: str, tags: dict) -> np.dtype:
    bits, form = tags.get(BITS, (1,))[0], tags.get(FORMAT, (1,))[0]
    kind = {1: "u", 2: "i", 3: "f"}.get(form)
    if kind is None or bits not in (8, 16, 32, 64):
        raise UnsupportedFormat(f"{bits} bits of sample format {form}")
    return np.dtype(f"{order}{kind}{bits // 8}")


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, each width ending one code early; 256 clears the table, 257 ends."""
    start = [bytes([v]) for v in range(256)] + [b"", b""]
    table, width, last, out, held, bits = list(start), 9, None, [], 0, 0
    for byte in raw:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(start), 9, None
            continue
        if code > len(table) or (last is None and code > 255):
            raise CorruptRaster("an LZW code is out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        if last is not None and len(table) < 4096:
            table.append(last + entry[:1])
        last, width = entry, min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _packbits(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        n = raw[at]
        if n < 128:
            out.append(raw[at + 1: at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(raw[at + 1: at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def _unpack(raw: bytes, tags: dict) -> bytes:
    how = tags.get(COMPRESSION, (NONE,))[0]
    if how == NONE:
        return raw
    if how in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompress(raw)
        except zlib.error as e:
            raise CorruptRaster(str(e)) from e
    if how == LZW:
        return _lzw(raw)
    if how == PACKBITS:
        return _packbits(raw)
    if how == ZSTD:
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        except zstandard.ZstdError as e:
            raise CorruptRaster(str(e)) from e
    raise UnsupportedFormat(f"compression {how}")


def _block(raw: bytes, kind: np.dtype, rows: int, width: int, depth: int, predictor: int) -> np.ndarray:
    """rows x width x depth values of an unpacked block."""
    if predictor == 3:  # bytes of a row apart, the highest first, each as the difference from the one ``depth`` before
        planes = np.frombuffer(raw, np.uint8, rows * width * depth * kind.itemsize).reshape(rows, width * kind.itemsize, depth)
        planes = np.add.accumulate(planes, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, width * depth)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, width, depth)
    img = np.frombuffer(raw, kind, rows * width * depth).reshape(rows, width, depth)
    if predictor == 2:
        return np.add.accumulate(img, axis=1, dtype=img.dtype)
    if predictor != 1:
        raise UnsupportedFormat(f"predictor {predictor}")
    return img


def tiff_window(read, order: str, tags: dict, row: int, col: int, height: int, width: int, bands: list[int] | None = None) -> np.ndarray:
    """bands x height x width of a window; only blocks that it touches are read."""
    full_h, full_w, n = tags[HEIGHT][0], tags[WIDTH][0], tags.get(SAMPLES, (1,))[0]
    kind, planar, tiled = _dtype(order, tags), tags.get(PLANAR, (1,))[0] == 2, TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (full_w, min(tags.get(ROWS, (full_h,))[0], full_h))
    offsets, counts = (tags[TILE_OFFSETS], tags[TILE_COUNTS]) if tiled else (tags[OFFSETS], tags[COUNTS])
    across, down = -(-full_w // bw), -(-full_h // bh)
    bands = list(range(n)) if bands is None else bands
    out = np.zeros((len(bands), height, width), kind.newbyteorder("="))
    for ty in range(row // bh, min(down, -(-(row + height) // bh))):
        for tx in range(col // bw, min(across, -(-(col + width) // bw))):
            for k, band in enumerate(bands if planar else bands[:1]):
                block = ty * across + tx + (band * across * down if planar else 0)
                rows = bh if tiled else min(bh, full_h - ty * bh)
                raw = _unpack(read(offsets[block], counts[block]), tags)
                depth = 1 if planar else n
                if len(raw) < rows * bw * depth * kind.itemsize:
                    raise CorruptRaster("a block is cut short")
                img = _block(raw, kind, rows, bw, depth, tags.get(PREDICTOR, (1,))[0])
                y0, y1 = max(row, ty * bh), min(row + height, ty * bh + rows, full_h)
                x0, x1 = max(col, tx * bw), min(col + width, tx * bw + bw, full_w)
                part = img[y0 - ty * bh: y1 - ty * bh, x0 - tx * bw: x1 - tx * bw]
                for j, b in [(k, 0)] if planar else enumerate(bands):
                    out[j, y0 - row: y1 - row, x0 - col: x1 - col] = part[:, :, b]
    return out


def tiff_info(tags: dict) -> dict:
    """crs, geotransform, nodata and text tags."""
    geo = None
    if MATRIX in tags:
        m = tags[MATRIX]
        geo = (m[3], m[0], m[1], m[7], m[4], m[5])
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[PIXEL_SCALE], tags[TIEPOINT]
        geo = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    nodata = tags.get(NODATA)
    text = dict(re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', tags.get(METADATA, ("",))[0]))
    try:
        nodata = float(nodata[0]) if nodata else None
    except ValueError:
        nodata = None
    return {"crs": crs_text(tags), "geotransform": geo, "nodata": nodata, "tags": text}


def geo_keys(tags: dict) -> dict[int, int | str | tuple[float, ...]]:
    """The geographic keys of a header with their values, whichever tag these are in."""
    flat, out = tags.get(GEO_KEYS, ()), {}
    for key, place, n, at in zip(*(flat[k::4] for k in range(4, 8))):
        if place == 0:
            out[key] = at
        elif place == GEO_NUMBERS:
            out[key] = tuple(tags.get(GEO_NUMBERS, ())[at: at + n])
        elif place == GEO_TEXTS:
            out[key] = tags.get(GEO_TEXTS, ("",))[0][at: at + n].rstrip("|\0")
    return out


def crs_text(tags: dict) -> str | None:
    """The reference system as text: EPSG:n; or the text that the file holds for its own system; or, for a system that is only described by keys, as those of other planets are, all
    of its keys as JSON behind GEOTIFF:, so that equal descriptions are equal texts and can be written again. None without a system."""
    keys = geo_keys(tags)
    for key in (PROJECTED, GEOGRAPHIC):
        if keys.get(key, OWN_SYSTEM) != OWN_SYSTEM:
            return f"EPSG:{keys[key]}"
    for key in (PROJECTED_NAME, GEOGRAPHIC_NAME, 1026):
        if str(keys.get(key, "")).startswith(TEXT_MARK):
            return keys[key][len(TEXT_MARK):]
    described = {str(k): v for k, v in sorted(keys.items()) if k != RASTER}
    return KEYS_MARK + json.dumps(described, separators=(",", ":"), ensure_ascii=False) if set(described) - {str(MODEL)} else None


def crs_tags(crs: str) -> dict[int, tuple[int, tuple | bytes]]:
    """The tags that hold a reference system: a code for EPSG:n, the keys of a GEOTIFF: text, and any other text (WKT, IAU and so on) as the name of a system of its own."""
    code = re.fullmatch(r"EPSG:(\d{1,5})", crs)
    if code and int(code[1]) < OWN_SYSTEM:
        geographic = 4000 <= int(code[1]) < 5000
        keys = {MODEL: 2 if geographic else 1, GEOGRAPHIC if geographic else PROJECTED: int(code[1])}
    elif crs.startswith(KEYS_MARK):
        keys = {int(k): tuple(v) if isinstance(v, list) else v for k, v in json.loads(crs[len(KEYS_MARK):]).items()}
    else:
        geographic = re.match(r"\s*(GEOGCS|GEOGCRS|GEODCRS)", crs) is not None
        kind, name = (GEOGRAPHIC, GEOGRAPHIC_NAME) if geographic else (PROJECTED, PROJECTED_NAME)
        keys = {MODEL: 2 if geographic else 1, kind: OWN_SYSTEM, name: TEXT_MARK + crs}
    rows, numbers, texts = [], [], b""
    for key, value in sorted((keys | {RASTER: PIXEL_IS_AREA}).items()):
        if isinstance(value, str):
            part = value.encode("latin-1", "backslashreplace") + b"|"
            rows += [key, GEO_TEXTS, len(part), len(texts)]
            texts += part
        elif isinstance(value, tuple):
            rows += [key, GEO_NUMBERS, len(value), len(numbers)]
            numbers += value
        else:
            rows += [key, 0, 1, value]
    out: dict[int, tuple[int, tuple | bytes]] = {GEO_KEYS: (3, (1, 1, 0, len(rows) // 4, *rows))}
    if numbers:
        out[GEO_NUMBERS] = (12, tuple(numbers))
    if texts:
        out[GEO_TEXTS] = (2, texts + b"\0")
    return out


def reader_of(data: bytes):
    return lambda offset, size: data[offset: offset + size]


def read_tiff(data: bytes) -> Raster:
    read = reader_of(data)
    try:
        order, tags = tiff_header(read)
        return Raster(tiff_window(read, order, tags, 0, 0, tags[HEIGHT][0], tags[WIDTH][0]), **tiff_info(tags))
    except (struct.error, KeyError, IndexError, ValueError) as e:
        raise CorruptRaster(str(e)) from e


def write_tiff(raster: Raster, tile: int = 256, big: bool | None = None) -> bytes:
    """A tiled, deflated GeoTIFF, a BigTIFF where its size needs one (or as ``big`` says). Two-dimensional data are one band; of three dimensions the first is the bands if it is at most 4, else the last."""
    data = raster.data
    if data.ndim == 2:
        data = data[None]
    elif data.ndim != 3:
        raise ValueError(f"{data.ndim} dimensions; 2 or 3 are needed")
    elif data.shape[0] > 4:
        data = np.moveaxis(data, 2, 0)
    _, h, w = data.shape
    blocks = [tiff_block(band[y: y + tile, x: x + tile], tile) for band in data for y in range(0, h, tile) for x in range(0, w, tile)]
    return tiff_head(data.shape, data.dtype, [len(b) for b in blocks], raster, tile, big) + b"".join(blocks)


def tiff_block(part: np.ndarray, tile: int) -> bytes:
    """One compressed block; pixels beyond the image are 0."""
    block = np.zeros((tile, tile), part.dtype.newbyteorder("<"))
    block[: part.shape[0], : part.shape[1]] = part
    return zlib.compress(block.tobytes())


def tiff_head(shape: tuple[int, int, int], dtype: np.dtype, sizes: Sequence[int], about: Raster, tile: int = 256, big: bool | None = None) -> bytes:
    """All of a tiled GeoTIFF before its blocks, which follow one another by band, row and column and have these sizes; about: whose reference system, nodata value and tags it gets."""
    n, h, w = shape
    kind = {"u": 1, "i": 2, "f": 3}[dtype.kind]
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (w,)), HEIGHT: (4, (h,)), BITS: (3, (dtype.itemsize * 8,) * n), COMPRESSION: (3, (DEFLATE,)), PHOTOMETRIC: (3, (1,)), SAMPLES: (3, (n,)), PLANAR: (3, (2 if n > 1 else 1,)),
        TILE_WIDTH: (3, (tile,)), TILE_HEIGHT: (3, (tile,)), FORMAT: (3, (kind,) * n),
    }
    if about.geotransform:
        c, a, b, f, d, e = about.geotransform
        tags[MATRIX] = (12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0))
    if about.crs:
        tags |= crs_tags(about.crs)
    if about.nodata is not None:
        tags[NODATA] = (2, f"{about.nodata:g}".encode() + b"\0")
    if about.tags:
        items = "".join(f'<Item name="{k}">{v}</Item>' for k, v in about.tags.items())
        tags[METADATA] = (2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0")
    # Files that could outgrow 32-bit offsets are BigTIFFs: wider counts, entries and offsets.
    big = sum(sizes) + 64 * len(sizes) + (1 << 20) >= 1 << 32 if big is None else big
    many, word, place = ("Q", "Q", 16) if big else ("H", "I", 4)
    room = struct.calcsize("<" + word)
    head = 16 if big else 8
    start = head + struct.calcsize("<" + many) + (4 + 2 * room) * (len(tags) + 2) + room
    tags[TILE_OFFSETS], tags[TILE_COUNTS] = (place, (0,) * len(sizes)), (4, tuple(sizes))

    def packed(kind: int, value) -> bytes:
        return value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{_TYPES[kind]}", *value)

    size = sum(len(p) + len(p) % 2 for k, v in tags.values() if len(p := packed(k, v)) > room)
    at, places = start + size, []
    for b in sizes:
        places.append(at)
        at += b
    tags[TILE_OFFSETS] = (place, tuple(places))
    entries, extra = b"", b""
    for tag in sorted(tags):
        k, v = tags[tag]
        p = packed(k, v)
        count = len(v)
        if len(p) <= room:
            entries += struct.pack(f"<HH{word}", tag, k, count) + p.ljust(room, b"\0")
        else:
            entries += struct.pack(f"<HH{word}{word}", tag, k, count, start + len(extra))
            extra += p + b"\0" * (len(p) % 2)
    magic = b"II+\0" + struct.pack("<HHQ", 8, 0, head) if big else b"II*\0" + struct.pack("<I", head)
    return magic + struct.pack("<" + many, len(tags)) + entries + struct.pack("<" + word, 0) + extra


def read_png(data: bytes) -> Raster:
    """Grey, RGB or palette-free PNGs of 8 or 16 bits, not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise CorruptRaster("no PNG header")
    at, body, size = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at: at + 8])
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", data[at + 8: at + 21])
        elif kind == b"IDAT":
            body += data[at + 8: at + 8 + n]
        at += 12 + n
    if size is None:
        raise CorruptRaster("no image header")
    w, h, bits, colour, _, _, interlaced = size
    if bits not in (8, 16) or interlaced or colour not in (0, 2, 4, 6):
        raise UnsupportedFormat(f"{bits} bits of colour type {colour}")
    n, step = {0: 1, 2: 3, 4: 2, 6: 4}[colour], bits // 8
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n * step)
    except (zlib.error, ValueError) as e:
        raise CorruptRaster(str(e)) from e
    rows, bpp = np.zeros((h, w * n * step), np.uint8), n * step
    before = np.zeros(w * n * step, np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if kind == 2:
            line = (line + before) & 255
        elif kind == 1:
            line = np.concatenate([np.cumsum(line[k::bpp]) & 255 for k in range(bpp)]).reshape(bpp, -1).T.ravel()
        elif kind in (3, 4):
            for k in range(len(line)):
                left, up, corner = (line[k - bpp] if k >= bpp else 0), before[k], (before[k - bpp] if k >= bpp else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[k] = (line[k] + guess) & 255
        rows[y], before = line, line
    img = rows.reshape(h, w, n) if step == 1 else rows.reshape(h, w, n, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
    return Raster(np.moveaxis(img, 2, 0))


def write_png(img: np.ndarray) -> bytes:
    return png_bytes(img)


#: Element types of PDS4 labels.
_PDS_TYPES = {
    "UnsignedByte": "u1", "SignedByte": "i1", "UnsignedLSB2": "<u2", "UnsignedMSB2": ">u2", "SignedLSB2": "<i2", "SignedMSB2": ">i2", "UnsignedLSB4": "<u4", "UnsignedMSB4": ">u4", "SignedLSB4": "<i4", "SignedMSB4": ">i4",
    "IEEE754LSBSingle": "<f4", "IEEE754MSBSingle": ">f4", "IEEE754LSBDouble": "<f8", "IEEE754MSBDouble": ">f8",
}


def read_pds4(label: bytes, files: Mapping[str, bytes]) -> Raster:
    """The first array of a PDS4 label; files by name, of which only the array's is looked up."""
    try:
        root = ElementTree.fromstring(label)
    except ElementTree.ParseError as e:
        raise CorruptRaster(str(e)) from e
    plain = lambda el: el.tag.rsplit("}", 1)[-1]
    found = lambda el, name: next((x for x in el.iter() if plain(x) == name), None)
    area = next((x for x in root.iter() if plain(x).startswith("File_Area")), root)
    array = next((x for x in area.iter() if plain(x).startswith(("Array_2D", "Array_3D"))), None)
    name = found(area, "file_name")
    if array is None or name is None or name.text.strip() not in files:
        raise CorruptRaster("the label names no array, or a file that is missing")
    kind = found(array, "data_type").text.strip()
    if kind not in _PDS_TYPES:
        raise UnsupportedFormat(f"data type {kind}")
    axes = sorted((int(found(x, "sequence_number").text), found(x, "axis_name").text.strip(), int(found(x, "elements").text)) for x in array.iter() if plain(x) == "Axis_Array")
    offset = int(found(array, "offset").text) if found(array, "offset") is not None else 0
    shape = tuple(n for _, _, n in axes)
    raw = files[name.text.strip()]
    kind = np.dtype(_PDS_TYPES[kind])
    if len(raw) < offset + int(np.prod(shape)) * kind.itemsize:
        raise CorruptRaster("the image file is cut short")
    img = np.frombuffer(raw, kind, int(np.prod(shape)), offset).reshape(shape).astype(kind.newbyteorder("="))
    if img.ndim == 3:
        img = np.moveaxis(img, [n.lower() for _, n, _ in axes].index("band"), 0)
    return Raster(img if img.ndim == 3 else img[None])


#: Element types of PDS3 labels by their last words, with the byte order.
_PDS3_KINDS = {"UNSIGNED_INTEGER": "u", "INTEGER": "i", "REAL": "f"}


def read_pds3(label: bytes, files: Mapping[str, bytes]) -> Raster:
    """The image of a detached PDS3 label (KEYWORD = VALUE lines); files by name, of which only the image's is looked up. Bands follow one another."""
    given = {k: v.strip() for k, v in re.findall(r"(?m)^\s*(\^?\w+)\s*=\s*([^\r\n]*)", label.decode("latin-1"))}
    number = lambda key, other: int(re.match(r"\d+", given.get(key, other))[0])
    try:
        h, w, bits, n = (number(k, d) for k, d in (("LINES", ""), ("LINE_SAMPLES", ""), ("SAMPLE_BITS", ""), ("BANDS", "1")))
        # ^IMAGE is "NAME", ("NAME", record) or ("NAME", byte <BYTES>), counted from 1.
        name, record, in_bytes = re.match(r'\(?\s*"([^"]+)"\s*(?:,\s*(\d+)\s*(<BYTES>)?)?', given["^IMAGE"]).groups()
        offset = (int(record or 1) - 1) * (1 if in_bytes else number("RECORD_BYTES", "1"))
        what = given["SAMPLE_TYPE"].strip('"')
    except (KeyError, TypeError, AttributeError) as e:
        raise CorruptRaster("the label describes no image in a file of its own") from e
    kind = next((v for k, v in _PDS3_KINDS.items() if what.endswith(k)), None)
    if kind is None or bits not in (8, 16, 32, 64):
        raise UnsupportedFormat(f"{bits} bits of {what}")
    if name not in files:
        raise CorruptRaster(f"{name}, which the label names, is missing")
    order = "<" if what.startswith(("LSB", "PC", "VAX")) else ">"
    dtype, raw = np.dtype(f"{order}{kind}{bits // 8}"), files[name]
    if len(raw) < offset + n * h * w * dtype.itemsize:
        raise CorruptRaster("the image file is cut short")
    return Raster(np.frombuffer(raw, dtype, n * h * w, offset).reshape(n, h, w).astype(dtype.newbyteorder("=")))


def read_any(path: str, data: bytes) -> Raster:
    """By the path's extension; jp2 has no decoder here."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if kind in ("tif", "tiff"):
        return read_tiff(data)
    if kind == "png":
        return read_png(data)
    if kind in ("img", "pds"):
        if data[:2] in (b"II", b"MM"):
            return read_tiff(data)
        return read_raw(data)
    raise UnsupportedFormat(f"{path}: tif, tiff, img, pds and png can be read, and labels (xml, lbl) and zips beside their files" + " (jp2 needs a decoder that isn't here)" * (kind == "jp2"))


def read_raw(data: bytes) -> Raster:
    """A headerless image: the first layout that fits the size."""
    from ..operators.rules import RAW_TYPES, RAW_WIDTHS

    for name, size in RAW_TYPES:
        n = len(data) // size
        for width in RAW_WIDTHS:
            if n % width == 0 and 100 < n // width < 1_000_000:
                return Raster(np.frombuffer(data, np.dtype(name), n).reshape(1, n // width, width))
    raise CorruptRaster("no known layout has this size")
