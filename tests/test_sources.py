"""Codecs, the raster data source, exports, jobs, settings and whole registrations."""

import io
import struct
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rasterloom.operators import features, rules
from rasterloom.plans import scenes
from rasterloom.plans.config import AppConfig, RegistrationConfig, preset
from rasterloom.plans.registration import register_arrays, register_pairs
from rasterloom.sources import codecs, raster, sinks
from rasterloom.streaming import jobs

GEO = (32.5, 0.001, 0.0, -69.5, 0.0, -0.001)


@given(st.sampled_from(["u1", "i2", "u2", "f4", "f8", "u4"]), st.integers(1, 3), st.integers(1, 300), st.integers(1, 300), st.sampled_from([None, "EPSG:4326", "EPSG:32633", 'GEOGCS["Moon 2000",DATUM["D_Moon_2000",SPHEROID["Moon",1737400,0]]]', "IAU_2015:30120"]))
@settings(max_examples=40, deadline=None)
def test_tiff_round_trip(kind, bands, h, w, crs):
    data = np.random.default_rng(h * w).integers(0, 200, (bands, h, w)).astype(kind)
    got = codecs.read_tiff(codecs.write_tiff(codecs.Raster(data, crs, GEO, 0.0, {"SENSOR_NAME": "x"}), 64))
    np.testing.assert_array_equal(got.data, data)
    assert (got.crs, got.geotransform, got.nodata, got.tags) == (crs, GEO, 0.0, {"SENSOR_NAME": "x"})


def test_tiff_window_and_errors():
    data = np.arange(2 * 300 * 500, dtype=np.uint16).reshape(2, 300, 500)
    read = codecs.reader_of(codecs.write_tiff(codecs.Raster(data)))
    order, tags = codecs.tiff_header(read)
    np.testing.assert_array_equal(codecs.tiff_window(read, order, tags, 130, 250, 100, 111, [1]), data[1:, 130:230, 250:361])
    with pytest.raises(codecs.CorruptRaster):
        codecs.read_tiff(b"II*\0garbage")
    with pytest.raises(codecs.CorruptRaster):
        codecs.read_tiff(codecs.write_tiff(codecs.Raster(data))[:5000])
    for name in ("a.txt", "a.jp2", "noext"):
        with pytest.raises(codecs.UnsupportedFormat, match="tif, tiff"):
            codecs.read_any(name, b"x")


def test_own_reference_systems():
    """A system that is only described by keys comes back as text, is kept when written, and differs from another radius."""
    moon = 'GEOTIFF:{"1024":1,"1026":"Moon equirectangular","2048":32767,"2057":[1737400.0],"2058":[1737400.0],"3072":32767,"3075":17,"3088":[0.0]}'
    raw = codecs.write_tiff(codecs.Raster(np.ones((1, 4, 5), np.uint8), moon, GEO))
    _, tags = codecs.tiff_header(codecs.reader_of(raw))
    assert tags[codecs.GEO_NUMBERS] == (1737400.0, 1737400.0, 0.0) and codecs.geo_keys(tags)[1026] == "Moon equirectangular"
    assert codecs.read_tiff(raw).crs == moon
    other = codecs.read_tiff(codecs.write_tiff(codecs.Raster(np.ones((1, 4, 5), np.uint8), moon.replace("1737400", "3396190"), GEO))).crs
    assert other != moon and other.startswith("GEOTIFF:")


def test_big_tiff():
    data = np.random.default_rng(0).integers(0, 60000, (2, 100, 130)).astype(np.uint16)
    raw = codecs.write_tiff(codecs.Raster(data, "EPSG:32633", GEO, 3.0, {"a": "b"}), 32, big=True)
    assert raw[:4] == b"II+\0"
    got = codecs.read_tiff(raw)
    np.testing.assert_array_equal(got.data, data)
    assert (got.crs, got.geotransform, got.nodata, got.tags) == ("EPSG:32633", GEO, 3.0, {"a": "b"})
    with pytest.raises(codecs.CorruptRaster):
        codecs.read_tiff(raw[:15])


def strip_tiff(block: bytes, kind: np.dtype, h: int, w: int, compression: int, predictor: int = 1) -> bytes:
    """A little-endian TIFF of one strip, made by hand."""
    form = {"u": 1, "i": 2, "f": 3}[kind.kind]
    tags = [(256, 3, w), (257, 3, h), (258, 3, kind.itemsize * 8), (259, 3, compression), (273, 4, 200), (278, 3, h), (279, 4, len(block)), (317, 3, predictor), (339, 3, form)]
    raw = b"II*\0" + struct.pack("<IH", 8, len(tags)) + b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + b"\0" * 4
    return raw.ljust(200, b"\0") + block


def lzw_encoded(data: bytes) -> bytes:
    bits, width, table, held = [], 9, {bytes([k]): k for k in range(256)}, b""
    put = lambda code: bits.append(format(code, f"0{width}b"))
    put(256)
    after = 258
    for byte in data:
        if held + bytes([byte]) in table:
            held += bytes([byte])
            continue
        put(table[held])
        table[held + bytes([byte])], after, held = after, after + 1, bytes([byte])
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
        if after >= 4094:
            put(256)
            table, after, width = {bytes([k]): k for k in range(256)}, 258, 9
    if held:
        put(table[held])
        after += 1
        width = 9 if after < 512 else 10 if after < 1024 else 11 if after < 2048 else 12
    put(257)
    text = "".join(bits)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


def test_lzw_of_the_standard():
    assert codecs._lzw(bytes.fromhex("800B6050220C0C8501")) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    with pytest.raises(codecs.CorruptRaster):
        codecs._lzw(bytes.fromhex("807FFFFF"))


@given(st.integers(1, 90), st.integers(1, 90), st.sampled_from([2, 50, 60000]))
@settings(max_examples=25, deadline=None)
def test_packed_strips(h, w, most):
    import zstandard

    data = np.random.default_rng(h * w).integers(0, most, (h, w)).astype("<u2")
    plain = data.tobytes()
    for how, block in ((5, lzw_encoded(plain)), (50000, zstandard.ZstdCompressor().compress(plain)), (32773, b"".join(bytes([len(p) - 1]) + p for p in (plain[i: i + 128] for i in range(0, len(plain), 128))))):
        np.testing.assert_array_equal(codecs.read_tiff(strip_tiff(block, data.dtype, h, w, how)).data[0], data)
    assert codecs._packbits(bytes([254, 7, 128, 1, 5, 6])) == bytes([7, 7, 7, 5, 6])
    floats = np.random.default_rng(w).normal(size=(h, w)).astype("<f4")
    planes = np.frombuffer(floats.astype(">f4").tobytes(), np.uint8).reshape(h, w, 4).transpose(0, 2, 1).reshape(h, 4 * w).astype(int)
    coded = np.diff(planes, axis=1, prepend=0).astype(np.uint8)
    np.testing.assert_array_equal(codecs.read_tiff(strip_tiff(coded.tobytes(), floats.dtype, h, w, 1, 3)).data[0], floats)


def test_big_endian_strips():
    data = np.arange(60, dtype=">u2").reshape(6, 10)
    tags = [(256, 3, 1, 10 << 16), (257, 3, 1, 6 << 16), (258, 3, 1, 16 << 16), (259, 3, 1, 1 << 16), (273, 4, 2, 200), (278, 3, 1, 3 << 16), (279, 4, 2, 208)]
    raw = b"MM\0*" + struct.pack(">I", 8) + struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHII", *t) for t in tags) + b"\0" * 4
    raw = raw.ljust(200, b"\0") + struct.pack(">IIII", 216, 276, 60, 60) + data.tobytes()
    np.testing.assert_array_equal(codecs.read_tiff(raw).data[0], data)


@given(st.integers(1, 40), st.integers(1, 40))
@settings(max_examples=20, deadline=None)
def test_png_round_trip(h, w):
    img = np.random.default_rng(h).integers(0, 256, (h, w)).astype(np.uint8)
    np.testing.assert_array_equal(codecs.read_png(codecs.write_png(img)).data[0], img)


def test_png_filters():
    import struct
    import zlib

    rows = [bytes([k]) + bytes((7 * j + k) % 256 for j in range(9)) for k in (1, 2, 3, 4, 0)]
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    got, before, wanted = codecs.read_png(png).data, [0] * 9, []
    for raw in rows:
        line = []
        for j, v in enumerate(raw[1:]):
            a, b, c = (line[j - 3] if j > 2 else 0), before[j], (before[j - 3] if j > 2 else 0)
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v + (0, a, b, (a + b) // 2, paeth)[raw[0]]) % 256)
        wanted.append(line)
        before = line
    np.testing.assert_array_equal(np.moveaxis(got, 0, 2).reshape(5, 9), wanted)


LABEL = """<?xml version="1.0"?><Product xmlns="http://pds.nasa.gov/pds4/pds/v1"><File_Area_Observational><File><file_name>a.img</file_name></File><Array_2D_Image><offset unit="byte">4</offset>
<Element_Array><data_type>UnsignedMSB2</data_type></Element_Array><Axis_Array><axis_name>Line</axis_name><elements>3</elements><sequence_number>1</sequence_number></Axis_Array>
<Axis_Array><axis_name>Sample</axis_name><elements>5</elements><sequence_number>2</sequence_number></Axis_Array></Array_2D_Image></File_Area_Observational></Product>"""


def test_pds4_and_raw():
    data = np.arange(15, dtype=">u2").reshape(3, 5)
    np.testing.assert_array_equal(codecs.read_pds4(LABEL.encode(), {"a.img": b"head" + data.tobytes()}).data[0], data)
    with pytest.raises(codecs.CorruptRaster):
        codecs.read_pds4(LABEL.encode(), {})
    assert codecs.read_any("x.IMG", bytes(256 * 102 * 2)).data.shape == (1, 102, 256)
    with pytest.raises(codecs.CorruptRaster):
        codecs.read_raw(b"abc")


PDS3 = b'PDS_VERSION_ID = PDS3\r\nRECORD_BYTES = 4\r\n^IMAGE = ("A.IMG", 2)\r\nOBJECT = IMAGE\r\n  LINES = 3\r\n  LINE_SAMPLES = 5\r\n  SAMPLE_BITS = 16\r\n  SAMPLE_TYPE = LSB_UNSIGNED_INTEGER\r\nEND_OBJECT\r\nEND\r\n'


def test_labels_and_bundles_are_rasters(spark, tmp_path):
    data = np.arange(15).reshape(3, 5)
    (tmp_path / "a.xml").write_text(LABEL)
    (tmp_path / "a.img").write_bytes(b"head" + data.astype(">u2").tobytes())
    (tmp_path / "b.lbl").write_bytes(PDS3)
    (tmp_path / "A.IMG").write_bytes(b"head" + data.astype("<u2").tobytes())
    for name, members in (("c.zip", {"d/a.xml": LABEL, "d/a.img": b"head" + data.astype(">u2").tobytes()}), ("d.zip", {"x.tif": codecs.write_tiff(codecs.Raster(data[None].astype(np.uint16)))}), ("e.zip", {"x.txt": "x"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for member, content in members.items():
                z.writestr(member, content)
    (tmp_path / "f.zip").write_bytes(b"PK garbage")
    with pytest.raises(codecs.CorruptRaster):
        codecs.read_pds3(PDS3, {})
    rows = {r.path.rsplit("/", 1)[-1]: r for r in raster.scan(spark, str(tmp_path)).collect()}
    for name in ("a.xml", "b.lbl", "c.zip", "d.zip"):
        assert (rows[name].error, rows[name].width, rows[name].height, rows[name].dtype) == (None, 5, 3, "uint16")
    assert rows["e.zip"].error.startswith("UnsupportedFormat") and rows["f.zip"].error.startswith("CorruptRaster")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.xml", "b.lbl", "c.zip", "d.zip", "e.zip")], "path string")
    done = {r.path.rsplit("/", 1)[-1]: r for r in raster.to_geotiff(files, str(tmp_path / "out")).collect()}
    assert done["e.zip"].error and not done["e.zip"].output
    for name in ("a.xml", "b.lbl", "c.zip", "d.zip"):
        np.testing.assert_array_equal(codecs.read_tiff(open(done[name].output, "rb").read()).data[0], data)


def test_data_source(spark, tmp_path):
    raster.register(spark)
    data = np.arange(2 * 70 * 90, dtype=np.int16).reshape(2, 70, 90)
    (tmp_path / "a.tif").write_bytes(codecs.write_tiff(codecs.Raster(data, "EPSG:4326", GEO), 32))
    tiles = spark.read.format("raster").option("path", str(tmp_path / "a.tif")).option("rows", 16).load()
    px = raster.pixels(spark.read.format("raster").option("path", str(tmp_path / "a.tif")).option("band", 2).load()).toPandas()
    got = np.zeros((70, 90))
    got[px["y"], px["x"]] = px["v"]
    np.testing.assert_array_equal(got, data[1])
    shares = spark.read.format("raster").option("path", str(tmp_path / "a.tif")).option("rows", 16).option("split", 4000).load()
    assert shares.rdd.getNumPartitions() > 2 and sorted(shares.collect()) == sorted(tiles.collect())
    window = spark.read.format("raster").option("path", str(tmp_path / "a.tif")).option("window", "10,20,5,7").load()
    assert raster.pixels(window).where("band = 1").agg(F.sum("v")).first()[0] == data[0, 10:15, 20:27].sum()
    crop = spark.read.format("raster").option("path", str(tmp_path / "a.tif")).option("most", 30).load()
    assert {(r.row_off, r.col_off, r.h, r.w) for r in crop.collect()} == {(20, 30, 30, 30)}
    out = tiles.withColumn("image", F.lit("copy")).repartition("image")
    out.write.format("raster").mode("append").option("path", str(tmp_path / "out")).option("crs", "EPSG:4326").option("geotransform", ",".join(map(str, GEO))).save()
    again = codecs.read_tiff((tmp_path / "out" / "copy.tif").read_bytes())
    np.testing.assert_array_equal(again.data, data)
    assert again.geotransform == GEO and again.crs == "EPSG:4326"


def test_tiles_in_any_partitions_make_whole_files(spark, tmp_path):
    raster.register(spark)
    data = {name: np.arange(k, k + 16 * 10, dtype=np.uint16).reshape(16, 10) for k, name in enumerate("abc")}
    rows = [(n, 1, y, 0, 4, 10, "uint16", d[y: y + 4].tobytes()) for y in range(0, 16, 4) for n, d in data.items()]
    tiles = spark.createDataFrame(rows, raster.TILE_SCHEMA).repartition(4, "row_off")
    raster.save(tiles, str(tmp_path / "out"), crs="EPSG:4326")
    for name, d in data.items():
        np.testing.assert_array_equal(codecs.read_tiff((tmp_path / "out" / f"{name}.tif").read_bytes()).data[0], d)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")) == ["a.tif", "b.tif", "c.tif"]
    for bad, at in ((tiles.repartitionByRange(4, "row_off"), "split"), (tiles.where("row_off <> 4"), "hole")):
        with pytest.raises(Exception, match="several partitions|in no tile|follow one another"):
            if at == "split":
                bad.write.format("raster").mode("append").option("path", str(tmp_path / at)).save()
            else:
                raster.save(bad, str(tmp_path / at))
        assert not list((tmp_path / at).glob("*.tif"))


def test_one_image_by_many_tasks(spark, tmp_path):
    """A strip in tiles of any sizes, bands and parts; the file is what one writer makes of the whole array, but for the order of nothing."""
    raster.register(spark)
    rng = np.random.default_rng(5)
    data = rng.integers(0, 60_000, (2, 1300, 90)).astype(np.uint16)
    rows = [(n, b + 1, y, x, min(170, 1300 - y), min(41, 90 - x), "uint16", data[b, y: y + 170, x: x + 41].tobytes()) for n in ("strip", "again") for b in range(2) for y in range(0, 1300, 170) for x in range(0, 90, 41)]
    tiles = spark.createDataFrame(rows, raster.TILE_SCHEMA).repartition(5)
    found = raster.save(tiles, str(tmp_path / "out"), side=64, part_bytes=40_000, crs="EPSG:32633", geotransform=",".join(map(str, GEO)), nodata="7").collect()
    assert {r.image for r in found} == {"strip", "again"}
    wanted = codecs.write_tiff(codecs.Raster(data, "EPSG:32633", GEO, 7.0), 64)
    for r in found:
        assert open(r.output, "rb").read() == wanted and r.bytes == len(wanted)
    with raster.OpenRaster(found[0].output) as f:
        np.testing.assert_array_equal(f.window(1111, 13, 60, 70).data, data[:, 1111:1171, 13:83])
    mixed = tiles.unionByName(spark.createDataFrame([("strip", 1, 0, 0, 1, 1, "uint8", b"x")], raster.TILE_SCHEMA))
    with pytest.raises(ValueError, match="tiles of"):
        raster.save(mixed, str(tmp_path / "mixed"))
    assert raster.save(tiles.limit(0), str(tmp_path / "none")).count() == 0


def test_scan_and_bundles(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(codecs.write_tiff(codecs.Raster(np.ones((3, 4), np.uint8), "EPSG:4326", GEO, tags={"SUN_ELEVATION": "x", "SOLAR_ELEVATION": "12.5"})))
    (tmp_path / "b.txt").write_text("no raster")
    (tmp_path / "c.tif").write_bytes(b"garbage")
    rows = {r.path.rsplit("/", 1)[-1]: r for r in raster.scan(spark, str(tmp_path)).collect()}
    assert (rows["a.tif"].width, rows["a.tif"].height, rows["a.tif"].error) == (4, 3, None)
    assert rows["b.txt"].error.startswith("UnsupportedFormat") and rows["c.tif"].error.startswith("CorruptRaster")
    sun = raster.scan(spark, str(tmp_path)).where("error is null").select(rules.first_number([F.element_at("tags", k) for k in rules.ELEVATION_TAGS]).alias("e")).first()
    assert sun.e == 12.5
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("d/x.xml", "<Product/>")
        z.writestr("d/y.xml", LABEL)
        z.writestr("d/a.img", b"raw")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    picked = rules.bundle_member(raster.unzip(spark, str(tmp_path)), ["bundle"]).collect()
    assert [(r.path, r["rank"]) for r in picked] == [("d/y.xml", 0)]


def test_exports(spark, tmp_path):
    m = spark.createDataFrame([("p", 1, 1.0005, 2.0, 3.0, 4.0, 0.0625), ("p", 2, 9.9996, 2.0, 3.0, 4.0, 0.5)], "pair_id string, idx long, sx double, sy double, rx double, ry double, confidence double")
    lines = [r.line for r in sinks.csv_lines(m, "idx", [("sx", 3), ("confidence", 3)]).orderBy("line").collect()]
    assert lines == ["0,%.3f,%.3f" % (1.0005, 0.0625), "1,%.3f,%.3f" % (9.9996, 0.5)]
    sinks.write_match_csv(m, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_match_csv(m.limit(0), str(tmp_path / "none"))
    f = json.loads(sinks.geojson_features(m, GEO).orderBy("idx").first().feature)
    assert f["geometry"]["coordinates"] == pytest.approx([32.5 + 0.001 * 3.5, -69.5 - 0.001 * 4.5])
    assert json.loads(sinks.geojson_features(m, None).orderBy("idx").first().feature)["geometry"]["coordinates"] == [3.0, 4.0]
    sinks.write_geojson(sinks.geojson_features(m, GEO), str(tmp_path / "geo"))
    px = spark.createDataFrame(pd.DataFrame([("s", y, x, float(y + x)) for y in range(40) for x in range(80)], columns=["image", "y", "x", "v"]))
    assert codecs.read_png(bytes(sinks.preview_png(px, 20).first().png)).data.shape == (1, 10, 20)
    report = sinks.report(spark.createDataFrame([("A", 1.0, None), ("B", float("nan"), float("inf"))], "case_id string, rmse double, psnr double"), ["rmse", "psnr"])
    assert report.splitlines()[2:] == ["| A | 1.000 | - |", "| B | nan | ∞ |"]


def test_settings(tmp_path):
    RegistrationConfig()
    for bad in ({"illumination_method": "x"}, {"pyramid_scale_factor": 1.0}, {"refinement_patch_size": 4}, {"match_threshold": 1.1}, {"ransac_confidence": 1.0}, {"max_keypoints": 0}, {"full_res_refine": 1}, {"transform_type": "similarity"}):
        with pytest.raises(ValueError):
            RegistrationConfig(**bad)
    (tmp_path / "c.json").write_text('{"pipeline": {"max_keypoints": 5}}')
    assert AppConfig.load(str(tmp_path / "c.json")).pipeline.max_keypoints == 5
    for text in ('{"pipeline": {"colour": 5}}', '{"registration": {}}', '{"web": {"hosts": "x"}}', '{"pipeline": {"device": "tpu"}}'):
        (tmp_path / "d.json").write_text(text)
        with pytest.raises(ValueError):
            AppConfig.load(str(tmp_path / "d.json"))
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("pipeline:\n  max_keypoints: 7\n  transform_type: affine\nstorage:\n")
    loaded = AppConfig.load(str(tmp_path / "c.yaml"))
    assert (loaded.pipeline.max_keypoints, loaded.pipeline.transform_type, loaded.storage.export_dir) == (7, "affine", "./exports")
    # Every section and setting that settings files have.
    whole = {
        "pipeline": {"illumination_method": "phase_congruency", "pyramid_levels": None, "pyramid_scale_factor": 0.5, "detection_method": "superpoint", "max_keypoints": 8192, "matching_method": "lightglue", "match_threshold": 0.2, "outlier_method": "magsac++",
                     "ransac_confidence": 0.999, "ransac_max_iters": 10000, "transform_type": None, "refine_subpixel": True, "refinement_patch_size": 21, "interpolation": "bicubic", "device": "auto"},
        "web": {"host": "0.0.0.0", "port": 8000, "upload_max_size_mb": 500, "results_dir": "./results", "cors_origins": ["*"]}, "storage": {"upload_dir": "./uploads", "results_dir": "./results", "export_dir": "./exports"},
    }
    import yaml

    (tmp_path / "whole.yaml").write_text("# all of them\n" + yaml.safe_dump(whole))
    loaded = AppConfig.load(str(tmp_path / "whole.yaml"))
    assert {k: {x: getattr(getattr(loaded, k), x) for x in v} for k, v in whole.items()} == whole
    (tmp_path / "empty.yaml").write_text("")
    assert AppConfig.load(str(tmp_path / "empty.yaml")) == AppConfig()
    assert preset("sift:bf") == ("sift", "bf")


def test_jobs(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    jobs.submit(spark.createDataFrame([("a", "b"), ("c", "bad")], "source_path string, reference_path string"), folder)

    def handle(pending):
        ok = F.col("reference_path") != "bad"
        return pending.select("job_id", F.when(ok, "completed").otherwise("failed").alias("status"), F.when(~ok, "no such file").alias("message"))

    for _ in range(2):
        jobs.process(spark, folder, str(tmp_path / "checkpoint"), handle).awaitTermination(120)
    states = {r.reference_path: (r.status, r.message) for r in jobs.latest(spark, folder).collect()}
    assert states == {"b": ("completed", None), "bad": ("failed", "no such file")}
    query = jobs.transitions(jobs.read_stream(spark, folder)).writeStream.format("memory").queryName("moves").option("checkpointLocation", str(tmp_path / "moves")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    moves = spark.table("moves").collect()
    assert len(moves) == 6 and all(r.valid for r in moves)


def test_heatmap_decoding():
    scores = np.full((65, 2, 3), -9.0)
    scores[64] = 5
    scores[8 * 3 + 5, 1, 2] = 20
    heat = features.decode_heatmap(scores)
    assert heat.shape == (16, 24) and np.unravel_index(heat.argmax(), heat.shape) == (11, 21) and heat[11, 21] > 0.99


def test_decoded_detections():
    rng = np.random.default_rng(2)
    scores, descriptors = np.full((65, 5, 6), -9.0), rng.normal(size=(16, 5, 6))
    scores[64] = 5
    for cell, y, x, v in ((10, 1, 1, 20), (11, 1, 1, 19), (40, 3, 4, 15)):  # the second is beside the first
        scores[cell, y, x] = v
    points, d = features.decode_detections(scores, descriptors)
    assert [tuple(p[:2]) for p in points] == [(32, 29), (10, 9)] and np.allclose(np.linalg.norm(d, axis=1), 1)
    assert len(features.decode_detections(scores, descriptors, most=1)[0]) == 1
    mask = np.zeros((40, 48))
    mask[20:] = 1
    assert [tuple(p[:2]) for p in features.decode_detections(scores, descriptors, mask=mask)[0]] == [(32, 29)]
    got = register_arrays(np.ones((64, 64)), np.ones((64, 64)), RegistrationConfig(illumination_method="clahe", detection_method="superpoint"))
    assert not got["success"] and "needs weights" in got["error"]


@pytest.mark.parametrize("name", "ABCDEFG")
def test_scenes(name):
    side = 512 if name == "G" else 256
    source, reference, truth, size, method = scenes.cases(side)[name]
    got = register_arrays(source, reference, RegistrationConfig(illumination_method=method, transform_type="affine"), 1.0, size)
    assert got["success"], got["error"]
    assert got["metrics"]["rmse"] < 1 and got["metrics"]["inlier_ratio"] > 0.3
    if truth is not None:
        assert scenes.point_error(truth, got["m"], side)[0] < 0.25


def test_register_pairs(spark, tmp_path):
    base = scenes.terrain(200)
    moved = scenes.warp(base, np.array([[1, 0, 6.0], [0, 1, -4], [0, 0, 1]]), base.shape)
    for name, img in (("s", np.stack([base, 255 - base])), ("r", moved[None])):
        (tmp_path / f"{name}.tif").write_bytes(codecs.write_tiff(codecs.Raster(img.astype(np.uint8), "EPSG:4326", GEO)))
    (tmp_path / "bad.tif").write_bytes(b"garbage")
    pairs = spark.createDataFrame([("ok", str(tmp_path / "s.tif"), str(tmp_path / "r.tif")), ("gone", "/none.tif", "/none.tif"), ("bad", str(tmp_path / "bad.tif"), str(tmp_path / "r.tif"))], "pair_id string, source string, reference string")
    got = {r.pair_id: r for r in register_pairs(pairs, RegistrationConfig(illumination_method="clahe"), str(tmp_path / "out")).collect()}
    assert got["ok"].success and np.allclose(np.array(got["ok"].m).reshape(3, 3)[:2, 2], [6, -4], atol=0.1)
    assert not got["gone"].success and got["gone"].stage == "load" and not got["bad"].success
    written = codecs.read_tiff(open(got["ok"].output, "rb").read())
    assert written.data.shape == (2, 200, 200) and written.geotransform == GEO
    # What can't be written fails its own pair, with the transform that was found.
    (tmp_path / "full").write_text("a file, no folder")
    lost = {r.pair_id: r for r in register_pairs(pairs, RegistrationConfig(illumination_method="clahe"), str(tmp_path / "full")).collect()}
    assert len(lost) == 3 and not lost["ok"].success and lost["ok"].stage == "export" and lost["ok"].error and lost["ok"].output is None
    assert np.allclose(lost["ok"].m, got["ok"].m) and lost["gone"].stage == "load"


def test_overlapping_windows(tmp_path):
    data = np.arange(100 * 120, dtype=np.uint16).reshape(1, 100, 120)
    place = lambda name, geo, crs="EPSG:32633": (tmp_path / name).write_bytes(codecs.write_tiff(codecs.Raster(data, crs, geo), 32)) and str(tmp_path / name)
    a, b = place("a.tif", (0.0, 1.0, 0.0, 100.0, 0.0, -1.0)), place("b.tif", (40.0, 0.5, 0.0, 90.0, 0.0, -0.5))
    s, r = raster.load_pair(a, b)
    np.testing.assert_array_equal(s.data, data[:, 10:60, 40:100])
    np.testing.assert_array_equal(r.data, data)
    assert s.geotransform == (40.0, 1.0, 0.0, 90.0, 0.0, -1.0)
    s, _ = raster.load_pair(a, b, 20)
    assert s.data.shape == (1, 20, 20) and s.geotransform[0] == 60.0
    far = place("c.tif", (500.0, 1.0, 0.0, 100.0, 0.0, -1.0))
    s, r = raster.load_pair(a, far, 50)
    np.testing.assert_array_equal(s.data, data[:, 25:75, 35:85])
    touching = place("d.tif", (120.0, 1.0, 0.0, 100.0, 0.0, -1.0))
    assert raster.load_pair(a, touching, 4096)[0].data.shape == (1, 100, 120)
    other = place("e.tif", (0.0, 1.0, 0.0, 100.0, 0.0, -1.0), "EPSG:32634")
    assert raster.load_pair(a, other)[0].data.shape == (1, 100, 120)


def test_sensors(spark):
    rows = [("/d/X_OHRC_1.tif", "", ""), ("/d/m1_NAC.tif", "tmc", ""), ("/d/a.tif", "", "KAGUYA cam"), ("/d/a.tif", "iirs", "ohrc"), ("/ohrc/a.tif", "", "")]
    df = spark.createDataFrame(rows, "path string, s string, i string")
    got = [r[0] for r in df.select(rules.sensor(F.col("path"), F.col("s"), F.col("i"))).collect()]
    assert got == ["ohrc", "lro_nac", "selene", "iirs", "unknown"]
    assert got == [rules.sensor_of(p, {"SENSOR_NAME": s, "INSTRUMENT_NAME": i}) for p, s, i in rows]
