"""Readers of the formats around the engine. Text formats parse in SQL functions; binary ones in Arrow batches over `binaryFile`."""

from __future__ import annotations

import sqlite3
import struct
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "type string, crs struct<properties:struct<name:string>>, features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, idx, x, y) of LineString features; others are left out."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    d = text.select("file", F.from_json("value", GEOJSON, {"mode": "FAILFAST"}).alias("j"))
    d = d.select("file", F.posexplode("j.features").alias("feature", "f")).where("f.geometry.type = 'LineString'")
    points = F.from_json("f.geometry.coordinates", "array<array<double>>")
    return d.select("file", "feature", F.posexplode(points).alias("idx", "p")).select("file", "feature", F.col("idx").cast("long"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def overpass_ways(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, idx, node, lon, lat, name) of each way's vertices."""
    kind = "elements array<struct<type:string,id:bigint,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>,tags:map<string,string>>>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["elements"]).alias("e")).where("e.type = 'way'")
    d = d.select(F.col("e.id").alias("way_id"), F.col("e.tags")["name"].alias("name"), F.posexplode(F.arrays_zip(F.col("e.nodes").alias("node"), F.col("e.geometry").alias("g"))).alias("idx", "v"))
    return d.select("way_id", F.col("idx").cast("long"), F.col("v.node").alias("node"), F.col("v.g.lon").alias("lon"), F.col("v.g.lat").alias("lat"), "name")


def hydrocron(spark: SparkSession, path: str) -> DataFrame:
    """Observations of a reach: CSV inside JSON; `no_data` rows and fill values below -1e10 go."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", "results struct<csv:string>")["results"]["csv"].alias("csv"))
    rows = d.select(F.split("csv", "\n").alias("l")).select(F.split(F.element_at("l", 1), ",").alias("head"), F.explode(F.slice("l", 2, F.size("l") - 1)).alias("line")).where("trim(line) <> ''")
    cell = lambda name: F.split("line", ",")[F.array_position("head", name).cast("int") - 1]
    number = lambda name: F.when(cell(name).cast("double") > -1e10, cell(name).cast("double"))
    d = rows.where(cell("time_str") != "no_data").select(cell("reach_id").alias("reach_id"), cell("time_str").alias("time_str"), number("wse").alias("wse"), number("width").alias("width"), cell("reach_q").cast("int").alias("quality"))
    return d.where("wse IS NOT NULL")


def stac_scenes(spark: SparkSession, path: str) -> DataFrame:
    kind = "features array<struct<id:string,bbox:array<double>,properties:map<string,string>,assets:map<string,struct<href:string>>>>"
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    p = F.col("f.properties")
    return d.select("f.id", F.to_date(F.substring(p["datetime"], 1, 10)).alias("date"), p["eo:cloud_cover"].cast("double").alias("cloud_pct"), F.col("f.bbox").alias("bbox"), F.transform_values("f.assets", lambda _, a: a["href"]).alias("hrefs"))


def binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that parse(path, bytes) gives for each file; one file is one task's work."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                found = parse(file, content.as_py())
                yield pa.RecordBatch.from_pydict(dict(zip(names, found)))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, schema)


#: Byte widths and struct codes of the TIFF field types; codes of compressions and predictors.
TIFF_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d"}
PLAIN, LZW, DEFLATE = (1,), (5,), (8, 32946)


def unlzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the high end, 256 clears the table, 257 ends."""
    out, table, bits, code_size, held, last = bytearray(), [], 0, 9, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < code_size:
            continue
        bits -= code_size
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, code_size, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        code_size = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return bytes(out)


def tiff_tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if not order or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("not a classic TIFF file")
    (at,) = struct.unpack(order + "I", content[4:8])
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, n = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind in TIFF_TYPES:
            size = n * struct.calcsize(TIFF_TYPES[kind])
            field = content[at + 10 + 12 * k : at + 14 + 12 * k]
            place = at + 10 + 12 * k if size <= 4 else struct.unpack(order + "I", field)[0]
            raw = content[place : place + size]
            tags[tag] = (raw,) if kind == 2 else struct.unpack(order + TIFF_TYPES[kind] * n, raw)
    return order, tags


def geotiff_window(content: bytes, row0: int, col0: int, rows: int, cols: int) -> np.ndarray:
    """(rows, cols, bands) in the pixel type. Only the tiles or strips under the window are unpacked; it must lie within the raster."""
    order, tags = tiff_tags(content)
    width, height, bands = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    if not (0 <= row0 <= row0 + rows <= height and 0 <= col0 <= col0 + cols <= width):
        raise ValueError("the window leaves the raster")
    if bands > 1 and tags.get(284, (1,))[0] != 1:
        raise ValueError("bands in planes of their own are not supported")
    packing, predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
    if packing not in PLAIN + LZW + DEFLATE:
        raise ValueError("compression is not supported")
    if len(set(tags[258])) > 1 or tags[258][0] not in (8, 16, 32, 64):
        raise ValueError("pixels of whole bytes, alike in all bands, are supported")
    code = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]] + str(tags[258][0] // 8)
    kind = np.dtype(order + code)
    tiled = 322 in tags
    w, h = (tags[322][0], tags[323][0]) if tiled else (width, min(tags.get(278, (height,))[0], height))
    places, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    across = -(-width // w)
    out = np.zeros((rows, cols, bands), kind.newbyteorder("="))
    for i in range(row0 // h, -(-(row0 + rows) // h)):
        for j in range(col0 // w, -(-(col0 + cols) // w)):
            k = i * across + j
            raw = content[places[k] : places[k] + sizes[k]]
            raw = zlib.decompress(raw) if packing in DEFLATE else unlzw(raw) if packing in LZW else raw
            high = h if tiled else min(h, height - i * h)
            if predictor == 3:  # bytes of a row by significance, highest first, differences of bytes
                planes = np.cumsum(np.frombuffer(raw, np.uint8)[: high * w * bands * kind.itemsize].reshape(high, -1, bands), axis=1, dtype=np.uint8)
                block = planes.reshape(high, kind.itemsize, w * bands).transpose(0, 2, 1).copy().view(">" + code).reshape(high, w, bands).astype(out.dtype)
            else:
                block = np.frombuffer(raw, kind)[: high * w * bands].reshape(high, w, bands).astype(out.dtype)
                if predictor == 2:  # differences in the pixel type, which wrap
                    block = np.cumsum(block.view(f"u{kind.itemsize}"), axis=1, dtype=f"u{kind.itemsize}").view(out.dtype)
            r, c = max(row0, i * h), max(col0, j * w)
            r1, c1 = min(row0 + rows, i * h + high), min(col0 + cols, j * w + w)
            out[r - row0 : r1 - row0, c - col0 : c1 - col0] = block[r - i * h : r1 - i * h, c - j * w : c1 - j * w]
    return out


def geotiff_place(content: bytes) -> dict:
    """North-west corner, pixel size, nodata and EPSG of a north-up GeoTIFF; refuses rotated ones."""
    _, tags = tiff_tags(content)
    if 34264 in tags:
        raise ValueError("rotated rasters are not supported")
    sx, sy = tags[33550][:2]
    i, j, _, px, py, _ = tags[33922][:6]
    keys = tags.get(34735, ())
    geo = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4) if keys[k + 1] == 0}
    shift = 0.5 if geo.get(1025) == 2 else 0.0  # a point pixel's tie is its centre
    nodata = float(tags[42113][0].strip(b"\0 ")) if 42113 in tags else None
    return {"x0": px - (i + shift) * sx, "y0": py + (j + shift) * sy, "sx": sx, "sy": sy, "nodata": nodata, "epsg": geo.get(3072) or geo.get(2048), "cols": tags[256][0], "rows": tags[257][0]}


def parse_geotiff(content: bytes) -> dict:
    """One-band GeoTIFF, plain, DEFLATE or LZW, strips or tiles, with predictors: z (rows x cols), origin, pixel size, nodata."""
    place = geotiff_place(content)
    if tiff_tags(content)[1].get(277, (1,))[0] != 1:
        raise ValueError("one band is read, not more")
    return place | {"z": geotiff_window(content, 0, 0, place["rows"], place["cols"])[:, :, 0].astype(float)}


def geotiff_rgb(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, row, col, r, g, b) of 8-bit rasters of three bands or more."""

    def parse(file: str, content: bytes):
        p = geotiff_place(content)
        z = geotiff_window(content, 0, 0, p["rows"], p["cols"])
        if z.dtype != np.uint8 or z.shape[2] < 3:
            raise ValueError("three bands of bytes are read as colours")
        r, c = np.divmod(np.arange(p["rows"] * p["cols"]), p["cols"])
        return [pa.array([file] * len(r)), r, c, *(z[:, :, k].reshape(-1).astype(np.int32) for k in range(3))]

    return binary(spark, path, parse, "raster_id string, row long, col long, r int, g int, b int")


def geotiff_cells_within(spark: SparkSession, path: str, west: float, south: float, east: float, north: float) -> DataFrame:
    """(raster_id, row, col, x, y, v) of the cells whose centres lie in a box: 8 or 16 bits, occurrence or reflectance; nodata is null."""

    def parse(file: str, content: bytes):
        p = geotiff_place(content)
        c0, r0 = max(0, int(np.ceil((west - p["x0"]) / p["sx"] - 0.5))), max(0, int(np.ceil((p["y0"] - north) / p["sy"] - 0.5)))
        c1, r1 = min(p["cols"], int(np.floor((east - p["x0"]) / p["sx"] - 0.5)) + 1), min(p["rows"], int(np.floor((p["y0"] - south) / p["sy"] - 0.5)) + 1)
        rows, cols = max(0, r1 - r0), max(0, c1 - c0)
        v = geotiff_window(content, min(r0, p["rows"]), min(c0, p["cols"]), rows, cols)[:, :, 0].reshape(-1).astype(float)
        r, c = np.divmod(np.arange(rows * cols), max(cols, 1))
        gone = v == p["nodata"] if p["nodata"] is not None else np.zeros(len(v), bool)
        return [pa.array([file] * len(v), pa.string()), r + r0, c + c0, p["x0"] + (c + c0 + 0.5) * p["sx"], p["y0"] - (r + r0 + 0.5) * p["sy"], pa.array(v, mask=gone)]

    return binary(spark, path, parse, "raster_id string, row long, col long, x double, y double, v double")


def geotiff_cells(spark: SparkSession, path: str) -> DataFrame:
    """(raster_id, row, col, x, y, z) at pixel centres; nodata is null."""

    def parse(file: str, content: bytes):
        t = parse_geotiff(content)
        rows, cols = t["z"].shape
        r, c = np.divmod(np.arange(rows * cols), cols)
        z = t["z"].reshape(-1)
        gone = np.isnan(z) | (z == t["nodata"] if t["nodata"] is not None else False)
        return [pa.array([file] * len(z)), r, c, t["x0"] + (c + 0.5) * t["sx"], t["y0"] - (r + 0.5) * t["sy"], pa.array(z, mask=gone)]

    return binary(spark, path, parse, "raster_id string, row long, col long, x double, y double, z double")


def write_geotiff(z: np.ndarray, x0: float, y0: float, size: float) -> bytes:
    """A north-up float32 GeoTIFF of one strip."""
    data = z.astype("<f4").tobytes()
    doubles = struct.pack("<3d", size, size, 0.0) + struct.pack("<6d", 0, 0, 0, x0, y0, 0)
    entries = [(256, 4, 1, z.shape[1]), (257, 4, 1, z.shape[0]), (258, 3, 1, 32), (259, 3, 1, 1), (262, 3, 1, 1), (273, 4, 1, None), (277, 3, 1, 1), (278, 4, 1, z.shape[0]), (279, 4, 1, len(data)), (339, 3, 1, 3), (33550, 12, 3, 0), (33922, 12, 6, 1)]
    base = 8 + 2 + 12 * len(entries) + 4
    place = {273: base + len(doubles), 33550: base, 33922: base + 24}
    head = b"II*\0" + struct.pack("<IH", 8, len(entries))
    return head + b"".join(struct.pack("<HHII", t, k, n, place.get(t, v)) for t, k, n, v in entries) + b"\0\0\0\0" + doubles + data


def wkb_points(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings or lines of a WKB LineString, Polygon or their Multi kinds."""
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if data[at] else ">"
        kind, n = struct.unpack(order + "II", data[at + 1 : at + 9])
        at += 9
        if kind % 1000 in (4, 5, 6):
            for _ in range(n):
                at = read(at)
            return at
        for count in [n] if kind % 1000 == 2 else [None] * n:
            if count is None:
                (count,) = struct.unpack(order + "I", data[at : at + 4])
                at += 4
            flat = struct.unpack(f"{order}{2 * count}d", data[at : at + 16 * count])
            out.append(list(zip(flat[::2], flat[1::2])))
            at += 16 * count
        return at

    read(0)
    return out


def geopackage_lines(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(file, fid, part, idx, x, y) of a layer's geometries."""

    def parse(file: str, content: bytes):
        rows: list[tuple] = []
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
            f.write(content)
            f.flush()
            with sqlite3.connect(f.name) as db:
                (column,) = db.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
                for fid, blob in db.execute(f'SELECT rowid, "{column}" FROM "{layer}" ORDER BY rowid'):
                    head = 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7]
                    rows += [(file, fid, p, i, *xy) for p, ring in enumerate(wkb_points(blob[head:])) for i, xy in enumerate(ring)]
        return [list(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]

    return binary(spark, path, parse, "file string, fid long, part long, idx long, x double, y double")


def parse_shapes(content: bytes) -> list[tuple[int, int, int, float, float]]:
    """(record, part, idx, x, y) of the polylines of a .shp file."""
    out, at = [], 100
    while at + 8 <= len(content):
        number, words = struct.unpack(">II", content[at : at + 8])
        body = content[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<I", body[:4])[0] % 10 in (3, 5):
            parts, points = struct.unpack("<II", body[36:44])
            starts = [*struct.unpack(f"<{parts}I", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            out += [(number, p, i - starts[p], xy[2 * i], xy[2 * i + 1]) for p in range(parts) for i in range(starts[p], starts[p + 1])]
    return out


def shapefile_lines(spark: SparkSession, path: str) -> DataFrame:
    def parse(file: str, content: bytes):
        rows = [(file, *r) for r in parse_shapes(content)]
        return [list(c) for c in zip(*rows)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]

    return binary(spark, path, parse, "file string, record long, part long, idx long, x double, y double")


def shape_box(content: bytes) -> tuple[float, float, float, float]:
    """(west, south, east, north) from the 100 bytes at the head of a .shp file."""
    if len(content) < 100 or struct.unpack(">I", content[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    return struct.unpack("<4d", content[36:68])


def meets(one: tuple, other: tuple) -> bool:
    return one[0] <= other[2] and other[0] <= one[2] and one[1] <= other[3] and other[1] <= one[3]


def shapefiles_meeting(spark: SparkSession, path: str, box: tuple[float, float, float, float]) -> list[str]:
    """The .shp files whose head meets the box: what a scan of basins has to read. One row per file reaches the driver."""

    def parse(file: str, content: bytes):
        return [[file], [meets(shape_box(content), box)]]

    return sorted(r.file for r in binary(spark, path, parse, "file string, hit boolean").where("hit").collect())


def parse_attributes(content: bytes) -> list[dict]:
    """Records of a .dbf file as text and numbers; deleted ones keep their place as None."""
    (count, head, size) = struct.unpack("<IHH", content[4:12])
    fields, at = [], 32
    while content[at] != 13:
        fields.append((content[at : at + 11].split(b"\0")[0].decode(), chr(content[at + 11]), content[at + 16]))
        at += 32
    out = []
    for k in range(count):
        row, at, record = content[head + k * size : head + (k + 1) * size], 1, {}
        for name, kind, width in fields:
            text = row[at : at + width].decode("utf-8", "replace").strip()
            record[name] = (float(text) if text and not set(text) & set("*") else None) if kind in "NF" else text
            at += width
        out.append(None if row[:1] == b"*" else record)
    return out


def reaches(spark: SparkSession, shapes: str, attributes: str) -> DataFrame:
    """Vertices of polylines with reach_id, width and dist_out of their records; `shapes` and `attributes` name files alike but for the suffix."""

    def parse(file: str, content: bytes):
        rows = [(file.rsplit(".", 1)[0], k + 1, int(r["reach_id"]) if r["reach_id"] is not None else None, r.get("width"), r.get("dist_out")) for k, r in enumerate(parse_attributes(content)) if r]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, kinds)]

    table = binary(spark, attributes, parse, "base string, record long, reach_id long, width double, dist_out double")
    lines = shapefile_lines(spark, shapes).withColumn("base", F.regexp_replace("file", "\\.[^.]*$", ""))
    return lines.join(table, ["base", "record"]).select("reach_id", "part", "idx", "x", "y", "width", "dist_out")


def geopackage_layers(spark: SparkSession, path: str) -> DataFrame:
    """(file, layer, kind, srs_id) of the feature layers, in order of their names."""

    def parse(file: str, content: bytes):
        with tempfile.NamedTemporaryFile(suffix=".gpkg") as f:
            f.write(content)
            f.flush()
            with sqlite3.connect(f.name) as db:
                rows = db.execute("SELECT c.table_name, g.geometry_type_name, g.srs_id FROM gpkg_contents c JOIN gpkg_geometry_columns g USING (table_name) WHERE c.data_type = 'features' ORDER BY 1").fetchall()
        return [[file] * len(rows), *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64())))]

    return binary(spark, path, parse, "file string, layer string, kind string, srs_id long")


#: What geometry each role takes.
ROLES = {"left_bank": ("LineString",), "right_bank": ("LineString",), "centreline": ("LineString",), "river_polygon": ("Polygon", "MultiPolygon")}


def geojson_role(spark: SparkSession, path: str, role: str) -> DataFrame:
    """(file, part, ring, idx, x, y, crs) of the one geometry that a role takes; FAILFAST on other kinds or more than one."""
    text = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    j = text.select("file", F.from_json("value", GEOJSON, {"mode": "FAILFAST"}).alias("j")).select("file", F.col("j.crs.properties.name").alias("crs"), F.col("j.features.geometry").alias("g"))
    kinds = F.filter("g", lambda g: g["type"].isin(*ROLES[role]))
    one = F.when(F.size(kinds) == 1, kinds[0]).otherwise(F.raise_error(F.lit(f"{role} takes one geometry of {' or '.join(ROLES[role])}")))
    j = j.withColumn("g", one)
    depth = {"LineString": 1, "Polygon": 2, "MultiPolygon": 3}
    shape = F.col("g.coordinates")
    parsed = {k: F.from_json(shape, "array<" * n + "array<double>" + ">" * n) for k, n in depth.items()}
    line = F.array(F.array(parsed["LineString"]))
    whole = F.when(F.col("g.type") == "LineString", line).when(F.col("g.type") == "Polygon", F.array(parsed["Polygon"])).otherwise(parsed["MultiPolygon"])
    d = j.select("file", "crs", F.posexplode(whole).alias("part", "r")).select("file", "crs", "part", F.posexplode("r").alias("ring", "p")).select("file", "crs", "part", "ring", F.posexplode("p").alias("idx", "p"))
    return d.select("file", "part", "ring", F.col("idx").cast("long").alias("idx"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), "crs")


def photon_hits(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, name, country, lon, lat) of waterways in a Photon answer, each object once, the first of equals."""
    kind = "features array<struct<geometry:struct<coordinates:array<double>>,properties:struct<osm_id:bigint,osm_key:string,osm_value:string,name:string,country:string>>>"
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)["features"]).alias("k", "f"))
    p = F.col("f.properties")
    rows = d.where((p["osm_key"] == "waterway") & p["osm_value"].isin("river", "canal", "stream") & p["name"].isNotNull())
    first = rows.groupBy(p["osm_id"].alias("osm_id")).agg(F.min_by(F.struct(p["name"].alias("name"), p["country"].alias("country"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat")), "k").alias("h"))
    return first.select("osm_id", "h.*")


def nominatim_hits(spark: SparkSession, path: str) -> DataFrame:
    """The same columns from a Nominatim answer."""
    kind = "array<struct<osm_id:bigint,class:string,type:string,name:string,display_name:string,lon:string,lat:string>>"
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", kind)).alias("k", "f"))
    rows = d.where((F.col("f.class") == "waterway") & F.col("f.type").isin("river", "canal", "stream"))
    name = F.coalesce(F.nullif("f.name", F.lit("")), F.trim(F.split("f.display_name", ",")[0]))
    country = F.trim(F.element_at(F.split("f.display_name", ","), -1))
    first = rows.groupBy(F.col("f.osm_id").alias("osm_id")).agg(F.min_by(F.struct(name.alias("name"), country.alias("country"), F.col("f.lon").cast("double").alias("lon"), F.col("f.lat").cast("double").alias("lat")), "k").alias("h"))
    return first.select("osm_id", "h.*")
