"""Members of JSON documents by byte ranges, against the json module."""

import json
import random

from tilewright.sources import annotations, files, ranges


def values(rng, depth=0):
    texts = ["", "a", '"', "\\", '\\"', "[{", "}],:", "é\u2028😀", "\\\\\\", "features", "x" * 300]
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind < 4:
        return [rng.choice(texts), rng.randrange(-9, 9), None, rng.random() < 0.5][kind]
    if kind == 4:
        return rng.choice([[], {}])
    if kind < 6:
        return [values(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(texts) + str(i): values(rng, depth + 1) for i in range(rng.randrange(4))}


def test_elements_at_all_kinds_of_cuts(spark, tmp_path):
    rng = random.Random(5)
    want = {}
    for i in range(12):
        items = [values(rng) for _ in range(rng.randrange(12))]
        root = {"crs": {"features": [1, 2], "type": "Other"}, 'x"features': [3], "type": "Whole", "features": items, "bbox": [[4], {"type": "no"}], "more": "features"}
        if i % 3 == 1:
            root = dict(reversed(root.items()))
        text = json.dumps(root, indent=rng.choice([None, 1, 4]), ensure_ascii=i % 2 == 0)
        (tmp_path / f"{i}.json").write_text(text)
        want[f"{i}.json"] = items
    odd = {
        "open": '{"type": "Whole", "features": [1, 2', "kind": '{"type": "Other", "features": [1]}', "none": '{"type": "Whole"}', "list": '["type", {"features": [1]}]', "quote": '{"type": "Whole", "features": [1]}"',
        "number": '{"type": "Whole", "features": 5}', "last": '{"type": "Other", "features": [1], "f\\u0065atures" : [2, 3] , "type"\n:\n"Whole"}', "empty": "", "later": '{"type": "Whole", "features": [1], "features": {}}', "closed": '{"type": "Whole", "features": [1]}}{',
    }
    for name, text in odd.items():
        (tmp_path / f"{name}.json").write_text(text)
    want["last.json"] = [2, 3]
    want = {name: items for name, items in want.items() if items}
    for size in (1, 7, 64, 1 << 20):
        listed = files.listing(spark, str(tmp_path))
        if size == 1:  # every place is a cut
            listed = listed.filter("name in ('0.json', '1.json', 'last.json', 'quote.json', 'open.json')")
        got = {}
        for r in sorted(ranges.elements(listed, "features", "Whole", size).collect()):
            got.setdefault(r["path"].rpartition("/")[2], []).append(json.loads(r["text"]))
        assert got == {name: items for name, items in want.items() if size > 1 or name in ("0.json", "1.json", "last.json")}, size
    assert ranges.elements(files.listing(spark, str(tmp_path)).filter("false"), "features").count() == 0


def test_escapes_over_the_beginning_of_a_piece():
    for text in (b'"a\\"b"{', b'"\\\\"{"\\\\\\"', b'\\\\\\\\"'):
        whole = ranges.Scan(text, 0, 0, 0).quotes.tolist()
        for k in range(1, len(text)):
            read = lambda at, n: text[at : at + n]  # noqa: B023, E731
            parts = [ranges.Scan(text[:k], 0, 0, 0).quotes.tolist(), [k + q for q in ranges.Scan(text[k:], 0, 0, ranges._slashes(read, k)).quotes.tolist()]]
            assert sum(parts, []) == whole


def test_collections_by_ranges_equal_whole_ones(spark, tmp_path):
    rng = random.Random(6)
    line = lambda n: [[rng.random(), rng.random()] for _ in range(n)]
    features = [{"type": "Feature", "id": i, "geometry": {"type": "LineString", "coordinates": line(rng.choice([1, 2, 900]))}, "properties": {"name": f'"{i}" é', "classification": "g"}} for i in range(60)] + [5, "x,y", None]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=2, ensure_ascii=False))
    read = lambda **more: annotations.read_features(spark, str(tmp_path), 2.0, 3.0, **more)
    plain = lambda rows: sorted(map(str, rows.drop("file", "place").collect()))
    assert plain(read(range_bytes=1000)) == plain(read()) and read(range_bytes=1000).count() == 63
    counts = annotations.import_counts(read(range_bytes=1000)).first()
    assert counts["imported"] == sum(len(f["geometry"]["coordinates"]) > 1 for f in features[:60])
