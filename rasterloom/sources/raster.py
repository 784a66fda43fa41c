"""Rasters as DataFrames: a Python data source that reads windows by row blocks and writes GeoTIFFs, and a reader over Spark's own file scan."""

from __future__ import annotations

import io
import itertools
import math
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import codecs
from .shared import Folder

TILE_SCHEMA = "image string, band int, row_off int, col_off int, h int, w int, dtype string, data binary"
META_SCHEMA = "path string, width int, height int, bands int, dtype string, crs string, geotransform array<double>, nodata double, tags map<string,string>, error string"


def _open(path: str):
    from pyarrow import fs

    # Local names may hold what a URI must not; Spark writes them as file:/name.
    local = path.removeprefix("file:") if re.match("file:/(?!/)", path) else path
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


class _Files:
    """The files of a folder by name, read when they are looked up."""

    def __init__(self, files, folder: str):
        self.files, self.folder = files, folder

    def __contains__(self, name: str) -> bool:
        return self.files.get_file_info(f"{self.folder}/{name}").is_file

    def __getitem__(self, name: str) -> bytes:
        with self.files.open_input_file(f"{self.folder}/{name}") as f:
            return f.read()


class _Share(InputPartition):
    """Share k of n of the blocks of some files."""

    def __init__(self, paths: list[str], k: int = 0, n: int = 1):
        self.paths, self.k, self.n = paths, k, n


class _TiffReader(DataSourceReader):
    """Files below ``split`` bytes are read many to a partition, larger ones in shares of their blocks of rows; the driver asks for sizes only, tasks read headers. The band, window and
    most options prune the blocks that are read. (Options, as Spark 4.1 keeps filters pushed into a Python source for later reads of the same DataFrame.)"""

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.rows, self.split = int(options.get("rows", 1024)), int(options.get("split", 64 << 20))
        self.window = [int(v) for v in options["window"].split(",")] if "window" in options else None  # row, col, height, width
        self.most = int(options["most"]) if "most" in options else None  # central crop
        self.band = int(options["band"]) if "band" in options else None

    def partitions(self) -> list[InputPartition]:
        out, few, size = [], [], 0
        for store in {}.fromkeys(p.split("://")[0] if "://" in p else "" for p in self.paths):
            mine = [p for p in self.paths if (p.split("://")[0] if "://" in p else "") == store]
            files, _ = _open(mine[0])
            for path, info in zip(mine, files.get_file_info([_open(p)[1] for p in mine])):
                n = -(-(info.size or 0) // self.split)
                if n > 1:
                    out += [_Share([path], k, n) for k in range(n)]
                    continue
                if few and size + (info.size or 0) > self.split:
                    out.append(_Share(few))
                    few, size = [], 0
                few, size = [*few, path], size + (info.size or 0)
        return out + ([_Share(few)] if few else [])

    def _blocks(self, tags: dict) -> list[tuple[int, int, int, int, int]]:
        """(band, row, col, height, width) of a file's blocks."""
        height, width, bands = tags[codecs.HEIGHT][0], tags[codecs.WIDTH][0], tags.get(codecs.SAMPLES, (1,))[0]
        row, col, h, w = self.window or (0, 0, height, width)
        if self.most:
            h, w = min(h, self.most), min(w, self.most)
            row, col = (height - h) // 2, (width - w) // 2
        return [(band, y, col, min(self.rows, row + h - y), w) for band in range(1, bands + 1) if self.band in (None, band) for y in range(row, row + h, self.rows)]

    def read(self, p: _Share) -> Iterator[tuple]:
        for path in p.paths:
            files, at = _open(path)
            with files.open_input_file(at) as f:
                read = lambda offset, size: f.read_at(size, offset)
                order, tags = codecs.tiff_header(read)
                blocks = self._blocks(tags)
                for band, row, col, h, w in blocks[len(blocks) * p.k // p.n: len(blocks) * (p.k + 1) // p.n]:
                    img = codecs.tiff_window(read, order, tags, row, col, h, w, [band - 1])[0]
                    yield path, band, row, col, h, w, img.dtype.name, img.tobytes()


class _Written(WriterCommitMessage):
    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


class _TiffWriter(DataSourceWriter):
    """Writes each image as <path>/<image>.tif; rows are tiles, an image's tiles are in one partition and next to one another (``save`` sees to that). Options: crs, geotransform (6 numbers), nodata.
    Tiles that don't cover their image, or an image in two partitions, are an error, and then no file appears. One image is held at a time."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def write(self, rows: Iterator) -> _Written:
        files, root = _open(self.options["path"])
        files.create_dir(root, recursive=True)
        parts: list[tuple[str, str]] = []
        for name, tiles in itertools.groupby(rows, lambda r: r["image"]):
            if name in {n for n, _ in parts}:
                raise ValueError(f"the tiles of {name} don't follow one another: use raster.save")
            part = f"{root}/.{name}.{uuid.uuid4().hex}.part"
            with files.open_output_stream(part) as f:
                f.write(codecs.write_tiff(self._image(name, list(tiles))))
            parts.append((name, part))
        return _Written(parts)

    def _image(self, name: str, tiles: list) -> codecs.Raster:
        shape = max(r["band"] for r in tiles), max(r["row_off"] + r["h"] for r in tiles), max(r["col_off"] + r["w"] for r in tiles)
        data, known = np.zeros(shape, tiles[0]["dtype"]), np.zeros(shape, bool)
        for r in tiles:
            at = r["band"] - 1, slice(r["row_off"], r["row_off"] + r["h"]), slice(r["col_off"], r["col_off"] + r["w"])
            data[at], known[at] = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"]), True
        if not known.all():
            raise ValueError(f"{name}: {known.size - known.sum()} of {known.size} pixels are in no tile of this partition")
        about = _about(self.options)
        return codecs.Raster(data, about.crs, about.geotransform, about.nodata)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _open(self.options["path"])
        parts = [p for m in messages if m for p in m.parts]
        names = [n for n, _ in parts]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("an image has tiles in several partitions: use raster.save")
        for name, part in parts:
            files.move(part, f"{root}/{name}.tif")

    def abort(self, messages: list[_Written | None]) -> None:
        files, _ = _open(self.options["path"])
        for m in messages:
            for _, part in m.parts if m else []:
                files.delete_file(part)


def _about(options: dict) -> codecs.Raster:
    geo, nodata = options.get("geotransform"), options.get("nodata")
    return codecs.Raster(np.zeros((1, 1)), options.get("crs"), tuple(float(v) for v in geo.split(",")) if geo else None, None if nodata is None else float(nodata))


def save(tiles: DataFrame, path: str, side: int = 256, part_bytes: int = 64 << 20, **options: str) -> DataFrame:
    """Writes tiles, whatever partitions they are in, as one tiled GeoTIFF an image, <path>/<image>.tif, a BigTIFF where it needs to be; (image, output, bytes) of what was written. options: crs, geotransform (6 numbers), nodata.

    Tiles are cut by the file's blocks of ``side`` pixels, and each block is put together and compressed on its own. Running sums of the blocks' sizes say where each goes; tasks write stretches of about ``part_bytes`` as parts, and then one
    stream an image joins header and parts. No task holds more than a part. Pixels in no tile, or kinds of values that differ, are an error, and then no file appears. Where tiles overlap, any of them may win.
    """
    folder = Folder(tiles.sparkSession, "geotiff")
    whole = tiles.groupBy("image").agg(F.max("band").alias("bands"), F.max(F.col("row_off") + F.col("h")).cast("long").alias("height"), F.max(F.col("col_off") + F.col("w")).cast("long").alias("width"), F.min("dtype").alias("dtype"), F.max("dtype").alias("other"))
    whole = folder.save(whole, "images")
    if (mixed := whole.where("dtype <> other").first()) is not None:
        raise ValueError(f"{mixed['image']}: tiles of {mixed['dtype']} and {mixed['other']}")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                data, rows = np.frombuffer(t.data, t.dtype).reshape(t.h, t.w), []
                for ty in range(t.row_off // side, (t.row_off + t.h - 1) // side + 1):
                    for tx in range(t.col_off // side, (t.col_off + t.w - 1) // side + 1):
                        y, x = max(t.row_off, ty * side), max(t.col_off, tx * side)
                        part = data[y - t.row_off: (ty + 1) * side - t.row_off, x - t.col_off: (tx + 1) * side - t.col_off]
                        rows.append((t.image, t.band, ty, tx, y - ty * side, x - tx * side, *part.shape, t.dtype, part.tobytes()))
                yield pd.DataFrame(rows, columns=["image", "band", "ty", "tx", "y", "x", "h", "w", "dtype", "data"])

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        shape = min(side, head["height"] - head["ty"] * side), min(side, head["width"] - head["tx"] * side)
        data, known = np.zeros(shape, head["dtype"]), np.zeros(shape, bool)
        for p in pdf.itertuples(index=False):
            at = slice(p.y, p.y + p.h), slice(p.x, p.x + p.w)
            data[at], known[at] = np.frombuffer(p.data, p.dtype).reshape(p.h, p.w), True
        blob = codecs.tiff_block(data, side)
        rows, columns = -(-head["height"] // side), -(-head["width"] // side)
        seq = ((head["band"] - 1) * rows + head["ty"]) * columns + head["tx"]
        return pd.DataFrame([[head["image"], seq, int(known.sum()), len(blob), blob]], columns=["image", "seq", "known", "size", "blob"])

    pieces = tiles.select("image", "band", "row_off", "col_off", "h", "w", "dtype", "data").mapInPandas(cut, "image string, band int, ty long, tx long, y int, x int, h int, w int, dtype string, data binary")
    made = pieces.join(whole.select("image", "height", "width"), "image").groupBy("image", "band", "ty", "tx").applyInPandas(block, "image string, seq long, known long, size long, blob binary")
    made = folder.save(made, "blocks")
    held = made.groupBy("image").agg(F.sum("known").alias("known")).join(whole, "image").withColumn("pixels", F.col("bands") * F.col("height") * F.col("width"))
    if (hole := held.where("known < pixels").first()) is not None:
        raise ValueError(f"{hole['image']}: {hole['pixels'] - hole['known']} of {hole['pixels']} pixels are in no tile")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("image").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = folder.save(made.select("image", "seq", "size").withColumn("part", F.floor(before / part_bytes)), "index")
    root = folder.path

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, at = _open(root)
        files.create_dir(f"{at}/parts", recursive=True)
        now, out, name, size = None, None, "", 0
        done = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if (r.image, r.part) != now:
                    if out is not None:
                        out.close()
                        done.append((*now, name, size))
                    now, name, size = (r.image, r.part), uuid.uuid4().hex, 0  # a repeated task has a name of its own
                    out = files.open_output_stream(f"{at}/parts/{name}")
                out.write(r.blob)
                size += len(r.blob)
        if out is not None:
            out.close()
            done.append((*now, name, size))
        yield pd.DataFrame(done, columns=["image", "part", "name", "bytes"])

    blobs = made.select("image", "seq", "blob").join(index.select("image", "seq", "part"), ["image", "seq"])
    parts = folder.save(blobs.repartition("image", "part").sortWithinPartitions("image", "part", "seq").mapInPandas(write, "image string, part long, name string, bytes long"), "written")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (files, at), (there, to) = _open(root), _open(path)
        there.create_dir(to, recursive=True)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                head = codecs.tiff_head((r.bands, r.height, r.width), np.dtype(r.dtype), [int(v) for v in r.sizes], _about(options), side)
                part = f"{to}/.{r.image}.{uuid.uuid4().hex}.part"
                with there.open_output_stream(part) as f:
                    f.write(head)
                    for name in r.names:
                        with files.open_input_stream(f"{at}/parts/{name}") as g:
                            while chunk := g.read(8 << 20):
                                f.write(chunk)
                there.move(part, f"{to}/{r.image}.tif")
                yield pd.DataFrame({"image": [r.image], "output": [f"{to}/{r.image}.tif"], "bytes": [len(head) + int(sum(r.sizes))]})

    def ordered(df: DataFrame, by: str, value: str, name: str) -> DataFrame:
        return df.groupBy("image").agg(F.transform(F.sort_array(F.collect_list(F.struct(by, value))), lambda v: v[value]).alias(name))

    each = whole.join(ordered(index, "seq", "size", "sizes"), "image").join(ordered(parts, "part", "name", "names"), "image")
    written = folder.save(each.select("image", F.col("bands").cast("int"), "height", "width", "dtype", "sizes", "names").mapInPandas(join, "image string, output string, bytes long"), "result")
    for name in ("parts", "blocks", "index"):
        folder.drop(name)
    return written


class RasterDataSource(DataSource):
    """``spark.read.format("raster")``: tiles of TIFFs; the path option takes files, with commas between."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _TiffWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RasterDataSource)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Metadata of all rasters below a path: Spark lists the files without reading them, tasks read headers by ranges (bundles and labelled images as a whole).
    What can't be read has an error, not an exception."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([_meta(p) for p in pdf["path"]], columns=[c.split()[0] for c in META_SCHEMA.split(", ")])

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return listed.mapInPandas(run, META_SCHEMA)


def _meta(path: str) -> tuple:
    try:
        with OpenRaster(path) as r:
            return path, r.width, r.height, r.bands, r.dtype.name, r.crs, list(r.geotransform) if r.geotransform else None, r.nodata, r.tags, None
    except (codecs.RasterError, OSError) as e:
        return path, None, None, None, None, None, None, None, None, f"{type(e).__name__}: {e}"


class OpenRaster:
    """A raster whose windows are read on demand: TIFFs by ranges, other formats as a whole. An xml or lbl file is a label beside its image; of a zip the member is read that
    ``rules.bundle_member`` takes."""

    def __init__(self, path: str):
        files, at = _open(path)
        self.path, self.file = path, files.open_input_file(at)
        self.read = lambda offset, size: self.file.read_at(size, offset)
        self.whole: codecs.Raster | None = None
        kind, head = path.lower().rsplit(".", 1)[-1], self.read(0, 4)
        self.file.seek(0)
        if kind in ("tif", "tiff", "img", "pds") and head[:2] in (b"II", b"MM"):
            try:
                self.order, self.header = codecs.tiff_header(self.read)
                self.dtype = codecs._dtype(self.order, self.header).newbyteorder("=")
            except (struct.error, ValueError, IndexError) as e:
                raise codecs.CorruptRaster(str(e)) from e
            self.bands, self.height, self.width = self.header.get(codecs.SAMPLES, (1,))[0], self.header[codecs.HEIGHT][0], self.header[codecs.WIDTH][0]
            info = codecs.tiff_info(self.header)
        else:
            if kind == "zip":
                self.whole = _bundled(path, self.file)
            elif kind in ("xml", "lbl"):
                self.whole = _labelled(kind, self.file.read(), _Files(files, at.rsplit("/", 1)[0]))
            elif kind in ("tif", "tiff", "png", "img", "pds"):
                self.whole = codecs.read_any(path, self.file.read())
            else:
                self.whole = codecs.read_any(path, b"")
            self.bands, self.height, self.width = self.whole.data.shape
            self.dtype = self.whole.data.dtype
            info = {k: getattr(self.whole, k) for k in ("crs", "geotransform", "nodata", "tags")}
        self.crs, self.geotransform, self.nodata, self.tags = info["crs"], info["geotransform"], info["nodata"], info["tags"]

    def __enter__(self) -> OpenRaster:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def window(self, row: int, col: int, height: int, width: int) -> codecs.Raster:
        """All bands of a window; its geotransform is the window's own."""
        if self.whole is not None:
            data = self.whole.data[:, row: row + height, col: col + width]
        else:
            data = codecs.tiff_window(self.read, self.order, self.header, row, col, height, width)
        geo = self.geotransform
        if geo:
            c, a, b, f, d, e = geo
            geo = (c + a * col + b * row, a, b, f + d * col + e * row, d, e)
        return codecs.Raster(data, self.crs, geo, self.nodata, self.tags)

    def centre(self, most: int) -> tuple[int, int, int, int]:
        h, w = min(self.height, most), min(self.width, most)
        return (self.height - h) // 2, (self.width - w) // 2, h, w

    def box(self) -> tuple[float, float, float, float]:
        """left, bottom, right, top."""
        c, a, b, f, d, e = self.geotransform
        xs, ys = [c + a * i + b * j for i in (0, self.width) for j in (0, self.height)], [f + d * i + e * j for i in (0, self.width) for j in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)

    def window_of(self, box: tuple[float, float, float, float], most: int) -> tuple[int, int, int, int]:
        """The whole pixels that cover a box, inside the raster, at least one, cut to the centre where a side exceeds ``most``."""
        c, a, b, f, d, e = self.geotransform
        inverse = np.linalg.inv(np.array([[a, b], [d, e]]))
        corners = np.array([inverse @ (x - c, y - f) for x in (box[0], box[2]) for y in (box[1], box[3])]).round(6)
        out = []
        for low, high, full in ((corners[:, 1].min(), corners[:, 1].max(), self.height), (corners[:, 0].min(), corners[:, 0].max(), self.width)):
            at = max(0, math.floor(low))
            n = max(1, min(math.ceil(high - low), full - at))
            out.append((at + max(0, (n - most) // 2), min(n, most)))
        return out[0][0], out[1][0], out[0][1], out[1][1]


def _labelled(kind: str, label: bytes, files) -> codecs.Raster:
    return (codecs.read_pds4 if kind == "xml" else codecs.read_pds3)(label, files)


class _Members:
    """The members of a zip by their names without folders, read when they are looked up."""

    def __init__(self, z: zipfile.ZipFile):
        self.z, self.names = z, {m.rsplit("/", 1)[-1]: m for m in sorted(z.namelist(), reverse=True) if not m.endswith("/")}

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __getitem__(self, name: str) -> bytes:
        return self.z.read(self.names[name])


def _bundled(path: str, file) -> codecs.Raster:
    from ..operators.rules import member_of

    try:
        with zipfile.ZipFile(file) as z:
            heads = {}
            for m in z.infolist():
                if not m.is_dir():
                    with z.open(m) as f:
                        heads[m.filename] = f.read(2000).decode("latin-1")
            name = member_of(heads)
            if name is None:
                raise codecs.UnsupportedFormat(f"{path}: no label and no raster in the zip")
            kind = name.lower().rsplit(".", 1)[-1]
            return _labelled(kind, z.read(name), _Members(z)) if kind in ("xml", "lbl") else codecs.read_any(name, z.read(name))
    except (zipfile.BadZipFile, zlib.error, ValueError) as e:  # Arrow tells a seek before the start as a ValueError
        raise codecs.CorruptRaster(f"{path}: {e}") from e


def to_geotiff(files: DataFrame, out: str) -> DataFrame:
    """(path, output, error) of rasters of any kind that ``OpenRaster`` reads (column path), each written as <out>/<name>.tif by the task that has it. Names must differ."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to, root = _open(out)
        to.create_dir(root, recursive=True)
        for pdf in batches:
            for path in pdf["path"]:
                name, error = f"{root}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.tif", None
                try:
                    with OpenRaster(path) as r:
                        data = codecs.write_tiff(r.window(0, 0, r.height, r.width))
                    part = f"{name}.{uuid.uuid4().hex}.part"
                    with to.open_output_stream(part) as f:
                        f.write(data)
                    to.move(part, name)
                except (codecs.RasterError, OSError) as e:
                    error = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"path": [path], "output": [None if error else name], "error": [error]})

    return files.select("path").mapInPandas(run, "path string, output string, error string")


def load_pair(source: str, reference: str, most: int = 4096) -> tuple[codecs.Raster, codecs.Raster]:
    """The parts of two rasters that show the same ground, at most ``most`` pixels a side; where they have no common reference system, or boxes that don't meet, the centre of each."""
    with OpenRaster(source) as a, OpenRaster(reference) as b:
        if a.crs and a.crs == b.crs and a.geotransform and b.geotransform:
            p, q = a.box(), b.box()
            common = max(p[0], q[0]), max(p[1], q[1]), min(p[2], q[2]), min(p[3], q[3])
            if common[2] > common[0] and common[3] > common[1]:
                return a.window(*a.window_of(common, most)), b.window(*b.window_of(common, most))
        return a.window(*a.centre(most)), b.window(*b.centre(most))


def pixels(tiles: DataFrame) -> DataFrame:
    """(image, band, y, x, v) of tiles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                img = np.frombuffer(r.data, r.dtype).reshape(r.h, r.w)
                y, x = np.indices(img.shape)
                yield pd.DataFrame({"image": r.image, "band": r.band, "y": y.ravel() + r.row_off, "x": x.ravel() + r.col_off, "v": img.ravel().astype(float)})

    return tiles.mapInPandas(run, "image string, band int, y long, x long, v double")


def tiles_of(px: DataFrame, side: int = 256, dtype: str = "float64") -> DataFrame:
    """Square tiles of pixels (image, y, x, v) of one band; missing pixels of a tile are an error."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        top, left, h, w = y.min(), x.min(), y.max() - y.min() + 1, x.max() - x.min() + 1
        if len(pdf) != h * w:
            raise ValueError(f"{pdf['image'].iloc[0]}: {len(pdf)} pixels in a tile of {h} x {w}")
        data = np.zeros((h, w), dtype)
        data[y - top, x - left] = pdf["v"].to_numpy()
        return pd.DataFrame({"image": pdf["image"].iloc[:1], "band": [1], "row_off": [top], "col_off": [left], "h": [h], "w": [w], "dtype": [dtype], "data": [data.tobytes()]})

    at = px.select("image", "y", "x", "v", F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx"))
    return at.groupBy("image", "ty", "tx").applyInPandas(make, TILE_SCHEMA)


def unzip(spark: SparkSession, path: str) -> DataFrame:
    """(bundle, path, head, content) of the members of the zip files below a path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, data in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            content = z.read(m)
                            yield pd.DataFrame({"bundle": [name], "path": [m.filename], "head": [content[:2000].decode("latin-1")], "content": [content]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInPandas(run, "bundle string, path string, head string, content binary")


def resolution(geotransform, crs, sensor):
    """Metres or degrees per pixel: from the geotransform where there is a reference system, else the sensor's own."""
    from ..operators.rules import DEFAULT_RESOLUTION

    own = F.create_map(*[F.lit(v) for kv in DEFAULT_RESOLUTION.items() for v in kv])
    return F.coalesce(F.when(crs.isNotNull(), F.abs(F.get(geotransform, F.lit(1)))), F.element_at(own, sensor))
