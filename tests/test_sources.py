"""Files that these tests write, read back."""

import numpy as np

from tilewright.sources import annotations, ini, tiff


def test_tiff_directories_and_tiles(spark, tmp_path):
    rng = np.random.default_rng(4)
    levels = [(rng.integers(0, 256, (70, 100), dtype=np.uint8), 32), (rng.integers(0, 256, (20, 30), dtype=np.uint8), 32)]
    (tmp_path / "a.tiff").write_bytes(tiff.bigtiff(levels, 0.5))
    (tmp_path / "b.tiff").write_bytes(b"no")
    rows = sorted(tiff.read_directories(spark, str(tmp_path)).collect(), key=lambda r: (r["path"], r["directory"] or 0))
    assert [(r["width"], r["height"], r["width_tiles"], r["height_tiles"], r["mpp_x"]) for r in rows[:2]] == [(100, 70, 4, 3, 0.5), (30, 20, 1, 1, 0.5)]
    assert rows[2]["directory"] is None and len(rows[0]["offsets"]) == 12
    wanted = spark.createDataFrame([(rows[0]["path"], 0, 5), (rows[0]["path"], 1, 0), (rows[0]["path"], 0, 99)], "path string, directory int, tile_index int")
    got = {(r["directory"], r["tile_index"]): r["data"] for r in tiff.read_tiles(spark, str(tmp_path), wanted).collect()}
    assert np.frombuffer(got[0, 5], np.uint8).reshape(32, 32).tolist() == levels[0][0][32:64, 32:64].tolist()
    assert np.frombuffer(got[1, 0], np.uint8).reshape(32, 32)[:20, :30].tolist() == levels[1][0].tolist()
    assert got[0, 99] is None
    assert tiff.resolution(0, 3) == 0.25 and tiff.resolution(40000, 3) == 0.25 and tiff.resolution(100, 2) == 0.25


def test_geojson_shapes(spark, tmp_path):
    lines = [
        '{"type":"Feature","id":1,"geometry":{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,3],[0,0]],[[1,1],[2,1],[2,2]]]},"properties":{"name":"a","classification":{"name":"g"}}}',
        '{"type":"Feature","id":2,"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4,5]]},"properties":{"classification":"h"}},',
        '{"type":"Feature","id":3,"geometry":{"type":"LineString","coordinates":[[1,2]]},"properties":{}}',
        '{"type":"Feature","id":4,"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1]]],[[[0,0],[2,0],[2,2],[0,0]]]]},"properties":{}}',
        "nonsense", "", '{"type":"FeatureCollection"}',
    ]
    (tmp_path / "x.json").write_text("\n".join(lines))
    got = sorted((r["ann_id"], r["part"], r["grp"], r["type"], len(r["ring"]), r["ring"][0]["x"]) for r in annotations.read_geojson(spark, str(tmp_path), 2.0, 2.0).collect())
    assert got == [(1, 0, "g", "Polygon", 3, 0.0), (2, 0, "h", "Point", 1, 2.0), (2, 1, "h", "Point", 1, 6.0), (4, 0, None, "Polygon", 3, 0.0), (4, 1, None, "Polygon", 3, 0.0)]


def test_xml_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<ASAP_Annotations><Annotations><Annotation Name="n &amp; m" Type="Dot" PartOfGroup="g" Color="#ffffff"><Coordinates><Coordinate Order="1" X="3" Y="4"/><Coordinate Order="0" X="1" Y="2"/></Coordinates></Annotation><Annotation Name="e" Type=""/></Annotations></ASAP_Annotations>')
    got = sorted(((r["name"], r["type"], [tuple(p) for p in r["ring"]]) for r in annotations.read_xml(spark, str(tmp_path), 2.0).collect()))
    assert got == [("e", "Polygon", []), ("n & m", "Dot", [(2.0, 2.0), (6.0, 4.0)])]


def test_options(spark, tmp_path):
    (tmp_path / "a.ini").write_text("x = 0\n[one]\n ; c\nk = v ; more\n[two]\na=b=c\r\n\r\n[three]\nq =\n")
    rows = ini.read_options(spark, str(tmp_path))
    assert sorted((r["section"], r["key"], r["value"]) for r in rows.collect()) == [("", "x", "0"), ("one", "k", "v"), ("three", "q", ""), ("two", "a", "b=c")]
    registered = spark.createDataFrame([("one", "k", "new"), ("four", "z", "1")], "section string, key string, value string")
    assert sorted((r["section"], r["value"]) for r in ini.merged(rows, registered).collect()) == [("", "0"), ("four", "1"), ("one", "new"), ("three", ""), ("two", "b=c")]


def element(tag, vr, value):
    import struct

    from tilewright.sources.dicom import LONG_VR

    value += b" " * (len(value) % 2)
    head = struct.pack("<HH", tag >> 16, tag & 0xFFFF) + vr.encode()
    return head + (struct.pack("<HI", 0, len(value)) if vr in LONG_VR else struct.pack("<H", len(value))) + value


def test_dicom_elements(spark, tmp_path):
    import struct

    from tilewright.sources import dicom

    item = struct.pack("<HHI", 0xFFFE, 0xE000, 0xFFFFFFFF) + element(0x00080100, "SH", b"A1") + struct.pack("<HHI", 0xFFFE, 0xE00D, 0)
    sequence = struct.pack("<HH", 0x0040, 0x0555) + b"SQ" + struct.pack("<HI", 0, 0xFFFFFFFF) + item + struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)
    body = element(0x00080008, "CS", rb"ORIGINAL\PRIMARY\VOLUME\NONE") + element(0x00280010, "US", struct.pack("<H", 256)) + element(0x00280011, "US", struct.pack("<H", 512)) + sequence + element(0x00480006, "UL", struct.pack("<I", 5000))
    whole = bytes(128) + b"DICM" + element(0x00020010, "UI", b"1.2.840.10008.1.2.1") + body
    (tmp_path / "a.dcm").write_bytes(whole)
    (tmp_path / "b.dcm").write_bytes(b"x")
    rows = dicom.read_elements(spark, str(tmp_path))
    got = {(r["parent"], r["tag"]): r["value"] or r["numbers"] for r in rows.collect() if r["tag"]}
    assert got["", "00020010"] == "1.2.840.10008.1.2.1" and got["00400555[0]", "00080100"] == "A1" and got["", "00280010"] == [256.0]
    one = dicom.instances(rows).collect()
    assert [(r["flavor"], r["columns"], r["tile_width"], r["tile_height"]) for r in one] == [("VOLUME", 5000, 512, 256)]


def test_whole_collections(spark, tmp_path):
    import json

    point, line = {"type": "Point", "coordinates": [1, 2]}, {"type": "LineString", "coordinates": [[0, 0], [3, None], ["x", 1], [2, 2, 9]]}
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    features = [
        {"type": "Feature", "id": 1, "geometry": {"type": "GeometryCollection", "geometries": [point, {"type": "GeometryCollection", "geometries": [line, {"type": "MultiPolygon", "coordinates": [[ring], [ring[:3]]]}]}]}, "properties": {"name": "é", "classification": {"name": "g", "color": [255, 300, -1]}}},
        {"type": "Feature", "id": 2, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[5, 5]]]}, "properties": {"classification": "h"}},
        {"type": "Feature", "id": 3, "geometry": {"type": "Polygon", "coordinates": [ring[:2] + ring[:1]]}},
        {"type": "Feature", "id": 4, "geometry": {"type": "Point", "coordinates": [7, 8]}, "properties": {"classification": {"name": "p", "color": 66051}}},
        5, {"type": "Other"}, {"type": "Feature", "id": 6, "geometry": None},
    ]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2, ensure_ascii=False))
    (tmp_path / "b.json").write_text('{"type": "Topology", "features": []}')
    got = sorted((r["ann_id"], r["part"], r["type"], len(r["ring"]), r["grp"], r["colour"]) for r in annotations.read_geojson(spark, str(tmp_path)).collect())
    g = ("g", "#ffff00")
    assert got == [(1, 0, "Point", 1, *g), (1, 1, "LineString", 2, *g), (1, 2, "Polygon", 3, *g), (1, 3, "Polygon", 3, *g), (2, 0, "LineString", 2, "h", None), (4, 0, "Point", 1, "p", "#010203")]
    counts = {r["file"].rpartition("/")[2]: (r["imported"], r["skipped"], r["success"]) for r in annotations.import_counts(annotations.read_features(spark, str(tmp_path))).collect()}
    assert counts == {"a.geojson": (3, 4, True)}
    rows = annotations.read_geojson(spark, str(tmp_path)).filter("ann_id = 1")
    annotations.write_geojson(rows, str(tmp_path / "out"))
    for file in (tmp_path / "out").glob("part-*"):
        assert json.loads(file.read_text())["type"] == "FeatureCollection"
    for by_line in (False, True):
        back = sorted((r["type"], len(r["ring"])) for r in annotations.read_geojson(spark, str(tmp_path / "out"), by_line=by_line).collect())
        assert back == [("LineString", 2), ("Point", 1), ("Polygon", 3), ("Polygon", 3)]


def test_xml_in_one_file(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<?xml version="1.0"?><ASAP_Annotations><AnnotationGroups><Group Name="g" Color="#ff0000" PartOfGroup="None"/></AnnotationGroups><AnnotationFeatures><Feature Name="f" RestrictToGroup="g"/><Feature Name="e"/></AnnotationFeatures>'
        '<Annotations><Annotation Name="n" Type="Dot" PartOfGroup="other"><Coordinates><Coordinate Order="0" X="1" Y="2"/></Coordinates><Features><Feature Name="f" Value="1"/><Feature Name="f" Value="2.5"/></Features></Annotation></Annotations></ASAP_Annotations>'
    )
    rows = annotations.read_xml(spark, str(tmp_path))
    assert [(r["name"], r["grp"], r["features"]) for r in rows.collect()] == [("n", "other", {"f": 2.5})]
    groups = annotations.read_xml_groups(spark, str(tmp_path))
    assert sorted((r["name"], r["colour"]) for r in annotations.known_groups(groups, rows).collect()) == [("g", "#ff0000"), ("other", "#000000")]
    assert sorted((r["name"], r["restrict_to_group"]) for r in annotations.read_xml_features(spark, str(tmp_path)).collect()) == [("e", None), ("f", "g")]


def test_files_by_their_first_bytes(spark, tmp_path):
    from pyspark.sql import functions as F

    from tilewright.sources import files

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a").write_bytes(bytes(128) + b"DICM" + bytes(1000))
    (tmp_path / "in" / "b.tif").write_bytes(b"II")
    (tmp_path / "in" / "deep" / "c.xyz").write_bytes(b"x")
    listed = files.listing(spark, str(tmp_path / "in"))
    read = files.read_at(listed, F.lit(0), F.lit(files.HEADER))
    got = {r["name"]: (r["kind"], r["length"], len(r["bytes"])) for r in read.withColumn("kind", files.kind(F.col("path"), F.col("bytes"))).collect()}
    assert got == {"a": ("dicom", 1132, 256), "b.tif": ("tiff", 2, 2), "c.xyz": ("openslide compatible", 1, 1)}
    assert {r["name"]: r["bytes"] for r in files.read_at(listed, F.lit(130), F.lit(2)).collect()} == {"a": b"CM", "b.tif": b"", "c.xyz": b""}
    gone = spark.createDataFrame([(f"file:{tmp_path}/none",)], "path string")
    assert files.read_at(gone, F.lit(0), F.lit(2)).first()["bytes"] is None
    with files.opened(f"file:{tmp_path}/in/a") as f:
        small = files.Blocks(f)
        small.SIZE = 100
        assert small(95, 60) == bytes(33) + b"DICM" + bytes(23) and small(1130, 10) == bytes(2) and small(120, 13) == bytes(8) + b"DICM" + bytes(1)
    flags = files.directory_flags(read.withColumn("kind", files.kind(F.col("path"), F.col("bytes"))))
    assert sorted((r["folder"].rpartition("/")[2], r["n_files"], r["contains_dicom"], r["contains_other"]) for r in flags.collect()) == [("deep", 1, False, True), ("in", 2, True, True)]


def test_sections_of_several_files(spark, tmp_path, monkeypatch):
    """A long section goes on in further files; a comment that ends one belongs to the option that begins the next."""
    monkeypatch.setattr(ini, "SPREAD_ROWS", 7)
    lines = [("long", 2 * k + c, f"k{k}=v{k}" if c else f"; {k}") for k in range(60) for c in (0, 1)] + [("short", 0, "a=b"), ("short", None, "z=1"), ("short", None, "y=2"), (None, 5, "n=0"), (None, 4, "; none")]
    ini.write_options(spark.createDataFrame(lines, "section string, place long, line string"), str(tmp_path / "o"))
    files = sorted((tmp_path / "o" / "section=long").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert text == "[long]\n" + "".join(f"; {k}\nk{k}=v{k}\n" for k in range(60))
    assert len(files) > 5 and all(f.read_text().count("\n") < 40 for f in files)
    assert any(f.read_text().splitlines()[0].startswith("k") for f in files)
    got = sorted(map(tuple, ini.read_with_comments(spark, str(tmp_path / "o")).collect()), key=str)
    want = [("long", f"k{k}", f"v{k}", f"; {k}") for k in range(60)] + [("short", "a", "b", None), ("short", "y", "2", None), ("short", "z", "1", None), (None, "n", "0", "; none")]
    assert got == sorted(want, key=str)


def test_lines_without_a_key_stay_out_of_the_join(spark):
    """Comments, of which a section has many, have no key to be joined by: they stay as they are."""
    lines = spark.createDataFrame([("s", 0, "; c"), ("s", 1, "a=1"), ("s", 2, ""), ("s", 3, None)], "section string, place long, line string")
    registered = spark.createDataFrame([("s", "a", "2"), ("s", "", "odd")], "section string, key string, value string")
    got = {r["place"]: r["line"] for r in ini.rewritten(lines, registered).collect()}
    assert got == {0: "; c", 1: "a=2", 2: "", 3: None, None: "=odd"}
