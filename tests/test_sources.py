import json
import sqlite3
import struct
import zlib

import numpy as np
import pytest

from riverline.sources import designs, readers, writers


def test_geojson_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(1, 0, 1.5, 2.0), (1, 1, 3.0, 4.0), (2, 0, 0.0, 0.0), (2, 1, 1.0, 1.0)], "line_id int, idx int, x double, y double")
    features = [json.loads(r[0]) for r in writers.geojson_features(points, "line_id").collect()]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = {(r.x, r.y) for r in readers.geojson_lines(spark, str(tmp_path / "a.geojson")).collect()}
    assert rows == {(1.5, 2.0), (3.0, 4.0), (0.0, 0.0), (1.0, 1.0)}


def test_geotiff_round_trip(spark, tmp_path):
    z = np.array([[1.0, 2.0, 3.0], [4.0, np.nan, 6.0]])
    (tmp_path / "d.tif").write_bytes(readers.write_geotiff(z, 100.0, 50.0, 10.0))
    rows = {(r.row, r.col): r for r in readers.geotiff_cells(spark, str(tmp_path / "d.tif")).collect()}
    assert rows[0, 2].z == 3.0 and rows[1, 1].z is None and (rows[1, 0].x, rows[1, 0].y) == (105.0, 35.0)


def test_geopackage(spark, tmp_path):
    wkb = struct.pack("<BII4d", 1, 2, 2, 0.0, 1.0, 2.0, 3.0)
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('banks', 'geom')")
    db.execute("CREATE TABLE banks (fid INTEGER PRIMARY KEY, geom BLOB)")
    db.execute("INSERT INTO banks VALUES (7, ?)", (b"GP\0\1" + struct.pack("<i", 32630) + wkb,))
    db.commit()
    db.close()
    rows = readers.geopackage_lines(spark, str(tmp_path / "g.gpkg"), "banks").orderBy("idx").collect()
    assert [(r.fid, r.idx, r.x, r.y) for r in rows] == [(7, 0, 0.0, 1.0), (7, 1, 2.0, 3.0)]


def test_hydrocron_and_overpass(spark, tmp_path):
    csv = "reach_id,time_str,wse,width,reach_q\n1,2024-01-01T00:00:00Z,10.5,120,0\n1,no_data,-999999999999.0,1,3\n1,2024-02-01T00:00:00Z,-999999999999.0,1,3\n"
    (tmp_path / "h.json").write_text(json.dumps({"results": {"csv": csv}}))
    assert [(r.wse, r.quality) for r in readers.hydrocron(spark, str(tmp_path / "h.json")).collect()] == [(10.5, 0)]
    way = {"type": "way", "id": 5, "nodes": [1, 2], "geometry": [{"lat": 1.0, "lon": 2.0}, {"lat": 3.0, "lon": 4.0}], "tags": {"name": "R"}}
    (tmp_path / "o.json").write_text(json.dumps({"elements": [way]}))
    assert [(r.node, r.lon) for r in readers.overpass_ways(spark, str(tmp_path / "o.json")).orderBy("idx").collect()] == [(1, 2.0), (2, 4.0)]


def test_csv_lines(spark):
    rows = spark.createDataFrame([("a,b", 1.5), (None, 2.0)], "name string, v double")
    assert [r[0] for r in writers.csv_lines(rows, ["made here"]).collect()][:2] == ["# made here", "name,v"]


def tiff(z, predictor=1, packing=1, tile=None, kind=None, extra=()):
    """A classic TIFF of one band or three: strips of two rows, or tiles."""
    z = np.atleast_3d(z)
    rows, cols, bands = z.shape
    h, w = (tile, tile) if tile else (2, cols)
    parts = []
    for r in range(0, rows, h):
        for c in range(0, cols, w):
            block = np.zeros((h if tile else min(h, rows - r), w, bands), z.dtype)
            piece = z[r : r + h, c : c + w]
            block[: piece.shape[0], : piece.shape[1]] = piece
            if predictor == 2:
                whole = block.view(f"u{z.dtype.itemsize}").copy()
                whole[:, 1:] -= whole[:, :-1].copy()
                raw = whole.tobytes()
            elif predictor == 3:
                planes = np.ascontiguousarray(block.astype(z.dtype.newbyteorder(">"))).view(np.uint8).reshape(block.shape[0], w, z.dtype.itemsize).transpose(0, 2, 1).reshape(block.shape[0], -1).copy()
                planes[:, 1:] -= planes[:, :-1].copy()
                raw = planes.tobytes()
            else:
                raw = block.tobytes()
            parts.append(zlib.compress(raw) if packing == 8 else lzw(raw) if packing == 5 else raw)
    code = {"u": 1, "i": 2, "f": 3}[z.dtype.kind]
    blob, values = b"", {256: (4, [cols]), 257: (4, [rows]), 258: (3, [8 * z.dtype.itemsize] * bands), 259: (3, [packing]), 277: (3, [bands]), 317: (3, [predictor]), 339: (3, [code] * bands), 33550: (12, [10.0, 10.0, 0.0]), 33922: (12, [0, 0, 0, 500.0, 900.0, 0]), **dict(extra)}
    at = 8
    offsets = []
    for p in parts:
        offsets.append(at + len(blob))
        blob += p
    values |= {322: (4, [w]), 323: (4, [h]), 324: (4, offsets), 325: (4, [len(p) for p in parts])} if tile else {278: (4, [h]), 273: (4, offsets), 279: (4, [len(p) for p in parts])}
    entries = b""
    for tag in sorted(values):
        kind, v = values[tag]
        raw = struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind] * len(v), *v)
        if len(raw) > 4:
            place, blob = at + len(blob), blob + raw
            raw = struct.pack("<I", place)
        entries += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at + len(blob)) + blob + struct.pack("<H", len(values)) + entries + b"\0\0\0\0"


def lzw(data):
    """A plain encoder, with the decoder's early change of code sizes."""
    table, out, size, last = {bytes([k]): k for k in range(256)}, [(256, 9)], 9, b""
    count = 258
    for k in range(len(data)):
        one = data[k : k + 1]
        if last + one in table:
            last += one
            continue
        out.append((table[last], size))
        table[last + one] = count
        count += 1
        size = 9 + (count >= 512) + (count >= 1024) + (count >= 2048)
        if count == 4094:
            out.append((256, size))
            table, count, size = {bytes([k]): k for k in range(256)}, 258, 9
        last = one
    out.append((table[last], size))
    count += 1
    out.append((257, 9 + (count >= 512) + (count >= 1024) + (count >= 2048)))
    bits = "".join(format(code, f"0{n}b") for code, n in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("packing", [1, 5, 8])
@pytest.mark.parametrize("tile", [None, 16])
def test_geotiff_pixels(packing, tile):
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 65536, (37, 41), dtype=np.uint16)
    whole[0, :3] = 300, 100, 200
    for z, predictor in ((whole, 1), (whole, 2), (whole.astype(np.int32) * -7, 2), (rng.normal(size=(37, 41)).astype(np.float32), 3), (rng.normal(size=(37, 41)), 3), (rng.integers(0, 9, (70, 80), dtype=np.uint8), 1)):
        content = tiff(z, predictor, packing, tile)
        assert np.array_equal(readers.parse_geotiff(content)["z"], z.astype(float)), (predictor, z.dtype)
        assert np.array_equal(readers.geotiff_window(content, 5, 7, 20, 19)[:, :, 0], z[5:25, 7:26])
    with pytest.raises(ValueError):
        readers.geotiff_window(tiff(whole), 30, 0, 20, 5)


def test_geotiff_windows_points_and_colours(spark, tmp_path):
    z = np.arange(600, dtype=np.uint16).reshape(20, 30)
    (tmp_path / "o.tif").write_bytes(tiff(z, tile=16))
    rows = readers.geotiff_cells_within(spark, str(tmp_path / "o.tif"), 520.0, 850.0, 555.0, 885.0).collect()
    assert {(r.row, r.col, r.v) for r in rows} == {(r, c, float(z[r, c])) for r in (1, 2, 3, 4) for c in (2, 3, 4, 5)}
    assert readers.geotiff_cells_within(spark, str(tmp_path / "o.tif"), 0.0, 0.0, 1.0, 1.0).count() == 0
    point = tiff(z, extra={34735: (3, [1, 1, 0, 2, 1025, 0, 1, 2, 3072, 0, 1, 32630])}.items())
    assert readers.parse_geotiff(point)["x0"] == 495.0 and readers.parse_geotiff(point)["epsg"] == 32630
    colours = np.random.default_rng(2).integers(0, 256, (5, 6, 3), dtype=np.uint8)
    (tmp_path / "c.tif").write_bytes(tiff(colours))
    assert {(r.row, r.col, r.r, r.g, r.b) for r in readers.geotiff_rgb(spark, str(tmp_path / "c.tif")).collect()} == {(r, c, *map(int, colours[r, c])) for r in range(5) for c in range(6)}


def shape_file(lines):
    records = b""
    for k, line in enumerate(lines, 1):
        body = struct.pack("<I4dII", 3, 0, 0, 0, 0, 1, len(line)) + struct.pack("<I", 0) + b"".join(struct.pack("<2d", *p) for p in line)
        records += struct.pack(">II", k, len(body) // 2) + body
    flat = [p for line in lines for p in line]
    box = (min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat))
    return struct.pack(">I20xI", 9994, 50 + len(records) // 2) + struct.pack("<II4d32x", 1000, 3, *box) + records


def test_reaches_with_attributes_and_boxes(spark, tmp_path):
    (tmp_path / "b.shp").write_bytes(shape_file([[(1.0, 2.0), (3.0, 4.0)], [(5.0, 6.0), (7.0, 8.0)]]))
    fields = [(b"reach_id", "N", 11), (b"width", "F", 8), (b"name", "C", 6)]
    head = b"".join(n.ljust(11, b"\0") + k.encode() + b"\0" * 4 + bytes([w]) + b"\0" * 15 for n, k, w in fields) + b"\r"
    rows = b" " + b"14560100021" + b"   120.5" + b"Sassan" + b" " + b"14560100031" + b"********" + b"      "
    (tmp_path / "b.dbf").write_bytes(struct.pack("<BBBBIHH20x", 3, 1, 1, 1, 2, 32 + len(head), 26) + head + rows)
    found = readers.reaches(spark, str(tmp_path / "b.shp"), str(tmp_path / "b.dbf")).orderBy("reach_id", "idx").collect()
    assert [(r.reach_id, r.idx, r.x, r.width) for r in found] == [(14560100021, 0, 1.0, 120.5), (14560100021, 1, 3.0, 120.5), (14560100031, 0, 5.0, None), (14560100031, 1, 7.0, None)]
    assert readers.shape_box((tmp_path / "b.shp").read_bytes()) == (1.0, 2.0, 7.0, 8.0)
    assert len(readers.shapefiles_meeting(spark, str(tmp_path / "b.shp"), (6.0, 7.0, 9.0, 9.0))) == 1 and readers.shapefiles_meeting(spark, str(tmp_path / "b.shp"), (8.0, 9.0, 9.0, 9.9)) == []


def test_layers_roles_and_search_hits(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "g.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER)")
    db.execute("CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT)")
    db.executemany("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'LINESTRING', 32630)", [("right",), ("left",)])
    db.executemany("INSERT INTO gpkg_contents VALUES (?, ?)", [("right", "features"), ("left", "features"), ("notes", "attributes")])
    db.commit()
    db.close()
    assert [(r.layer, r.srs_id) for r in readers.geopackage_layers(spark, str(tmp_path / "g.gpkg")).collect()] == [("left", 32630), ("right", 32630)]
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    geo = {"type": "FeatureCollection", "crs": {"properties": {"name": "EPSG:32630"}}, "features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {}}, {"geometry": {"type": "LineString", "coordinates": ring[:2]}, "properties": {}}]}
    (tmp_path / "p.geojson").write_text(json.dumps(geo))
    got = readers.geojson_role(spark, str(tmp_path / "p.geojson"), "river_polygon").orderBy("idx").collect()
    assert [(r.x, r.y, r.crs) for r in got] == [(float(x), float(y), "EPSG:32630") for x, y in ring]
    assert readers.geojson_role(spark, str(tmp_path / "p.geojson"), "centreline").count() == 2
    (tmp_path / "n.geojson").write_text(json.dumps(geo | {"features": geo["features"][:1]}))
    with pytest.raises(Exception, match="centreline takes one geometry"):
        readers.geojson_role(spark, str(tmp_path / "n.geojson"), "centreline").collect()
    hit = lambda i, kind, name: {"geometry": {"coordinates": [i + 0.5, 6.0]}, "properties": {"osm_id": i, "osm_key": "waterway", "osm_value": kind, "name": name, "country": "CI"}}
    (tmp_path / "ph.json").write_text(json.dumps({"features": [hit(1, "river", "Sassandra"), hit(1, "river", "other"), hit(2, "dam", "x"), hit(3, "canal", None)]}))
    assert [tuple(r) for r in readers.photon_hits(spark, str(tmp_path / "ph.json")).collect()] == [(1, "Sassandra", "CI", 1.5, 6.0)]
    (tmp_path / "no.json").write_text(json.dumps([{"osm_id": 7, "class": "waterway", "type": "river", "display_name": "Bia, South, Ghana", "lon": "1.5", "lat": "6.5"}, {"osm_id": 8, "class": "place", "type": "town", "lon": "1", "lat": "1"}]))
    assert [tuple(r) for r in readers.nominatim_hits(spark, str(tmp_path / "no.json")).collect()] == [(7, "Bia", "Ghana", 1.5, 6.5)]


def test_stac_scenes(spark, tmp_path):
    scene = {"id": "S2A", "bbox": [1.0, 2.0, 3.0, 4.0], "properties": {"datetime": "2024-03-05T10:00:00Z", "eo:cloud_cover": 12.5}, "assets": {"green": {"href": "a.tif"}}}
    (tmp_path / "s.json").write_text(json.dumps({"features": [scene]}))
    r = readers.stac_scenes(spark, str(tmp_path / "s.json")).first()
    assert (r.id, str(r.date), r.cloud_pct, r.bbox, r.hrefs) == ("S2A", "2024-03-05", 12.5, [1.0, 2.0, 3.0, 4.0], {"green": "a.tif"})


def test_designs(spark, tmp_path):
    schema = {"type": "object", "required": ["format", "project"], "additionalProperties": False, "properties": {"format": {"const": "0.4"}, "project": {"$ref": "#/defs/project"}, "inputs": {}, "stages": {}, "options": {"type": "array", "items": {"type": "object"}, "minItems": 1}}, "defs": {"project": {"type": "object", "properties": {"name": {"type": "string", "minLength": 1}, "depth": {"type": ["number", "null"], "exclusiveMinimum": 0, "maximum": 9}}}}}
    good = {"format": "0.4", "project": {"name": "A", "depth": 2.5}, "options": [{}]}
    assert designs.breaks(schema, good) == []
    bad = {"format": "0.4", "project": {"name": "", "depth": 0}, "options": [1], "more": 1}
    assert designs.breaks(schema, bad) == ["/project/name: wrong length", "/project/depth: out of bounds", "/options/0: not object", "/more: nothing is allowed here"]
    assert designs.breaks(schema, {"format": "0.4"}) == ["/project: missing"]
    assert designs.opened(json.dumps(good | {"format": 3}), schema)["format"] == "0.4"
    for text in (json.dumps(good | {"format": "0.2"}), json.dumps(bad)):
        with pytest.raises(ValueError):
            designs.opened(text, schema)
    assert designs.canonical({"b": [1, {"d": None, "c": "é"}], "a": 1.5}) == '{"a":1.5,"b":[1,{"c":"é","d":null}]}'
    (tmp_path / "d.json").write_text(json.dumps(good))
    r = designs.documents(spark, str(tmp_path / "d.json"), schema).first()
    assert (r.project, r.options, r.stages) == ("A", "[{}]", "null")
    sets = {"id": "own", "version": "1", "rules": [{"id": "w", "measure": "width", "compare": ">=", "consequence": "blocking", "sizes": True, "applies_when": {"class": ["A"]}, "limit": {"k": "3.2"}}]}
    (tmp_path / "r1.json").write_text(json.dumps(sets))
    (tmp_path / "r2.json").write_text(json.dumps(sets | {"rules": [sets["rules"][0] | {"sizes": False}]}))
    one, two = (designs.rule_sets(spark, str(tmp_path / f)) for f in ("r1.json", "r2.json"))
    assert designs.loaded(one, one).count() == 1 and one.first().limit == {"k": "3.2"}
    with pytest.raises(ValueError):
        designs.loaded(one, two)


def test_utm_against_surveyed_points(spark):
    from pyspark.sql import functions as F

    from riverline.functions import projection

    points = [(-64.386106511, -55.338107031, 20, True, 412082.981525, 3866708.533984), (173.301527648, 26.530197689, 59, False, 729325.079356, 2936460.089290), (64.876024241, -78.530542359, 41, True, 541637.149866, 1281752.384067)]
    d = spark.createDataFrame(points, "lon double, lat double, zone int, south boolean, e double, n double")
    c = [F.col(k) for k in ("lon", "lat", "e", "n", "zone", "south")]
    for r in d.select("*", *(v.alias(k) for k, v in zip(("east", "north"), projection.utm_forward(c[0], c[1], c[4], c[5]))), *(v.alias(k) for k, v in zip(("lo", "la"), projection.utm_inverse(c[2], c[3], c[4], c[5])))).collect():
        assert abs(r.east - r.e) < 1e-3 and abs(r.north - r.n) < 1e-3 and abs(r.lo - r.lon) < 1e-8 and abs(r.la - r.lat) < 1e-8


def test_width_methods():
    from riverline.functions import plugins

    one = plugins.WidthMethod("one", lambda b: b, lambda b: b, lambda b: b)
    plugins.register(one, replace=True)
    assert plugins.width_method("one") is one
    with pytest.raises(ValueError):
        plugins.register(one)
    with pytest.raises(KeyError):
        plugins.width_method("none such")
