"""DICOM files read at places: large pixels stepped over, tables of offsets, fragments of frames."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.plans import formats
from tilewright.sources import dicom, files


def body(pixels, frames=b"3", table=b""):
    return bytes(128) + b"DICM" + dicom.packed(0x00020010, "UI", b"1.2.840.10008.1.2.1") + dicom.packed(0x00280008, "IS", frames) + table + pixels


def item(part):
    return struct.pack("<HHI", 0xFFFE, 0xE000, len(part)) + part


HEAD, END = struct.pack("<HH", 0x7FE0, 0x0010) + b"OB" + struct.pack("<HI", 0, dicom.UNDEFINED), struct.pack("<HHI", 0xFFFE, 0xE0DD, 0)


class Counted:
    def __init__(self, file):
        self.file, self.read = file, 0

    def size(self):
        return self.file.size()

    def read_at(self, n, at):
        self.read += n
        return self.file.read_at(n, at)


def test_pixels_beyond_four_gigabytes_are_stepped_over(tmp_path):
    big, start = 3_000_000_000, body(HEAD + item(b""))
    path = tmp_path / "big.dcm"
    with open(path, "wb") as f:  # holes: the file takes no space
        f.write(start)
        for part in range(2):
            f.write(struct.pack("<HHI", 0xFFFE, 0xE000, big))
            f.seek(big, 1)
        f.write(END + dicom.packed(0xFFFCFFFC, "LO", b"after"))
    with files.opened(f"file:{path}") as f:
        counted = Counted(f)
        rows = dicom.file_elements(dicom.Places(counted))
        assert rows[-1][1:4] == ("FFFCFFFC", "LO", "after") and rows[-2][6] == 2 * big + 32
        assert counted.read < 50_000
        assert list(dicom.file_fragments(dicom.Places(f))) == [(None, 0, len(start) + 8, big), (None, 1, len(start) + 16 + big, big)]


def test_frames_by_each_kind_of_table():
    parts = [b"aa", b"bbbb", b"cc", b"dddddd"]
    pixels = b"".join(map(item, parts))
    found = lambda data: [(frame, part, data[at : at + n]) for frame, part, at, n in dicom.file_fragments(data)]
    want = [(0, 0, b"aa"), (1, 0, b"bbbb"), (1, 1, b"cc"), (2, 0, b"dddddd")]
    assert found(body(HEAD + item(struct.pack("<3I", 0, 10, 32)) + pixels + END)) == want
    assert found(body(HEAD + item(b"") + pixels + END, table=dicom.packed(0x7FE00001, "OV", struct.pack("<3Q", 0, 10, 32)))) == want
    assert [f[:2] for f in found(body(HEAD + item(b"") + pixels + END, b"4"))] == [(0, 0), (1, 0), (2, 0), (3, 0)]
    assert [f[:2] for f in found(body(HEAD + item(b"") + pixels + END, b"1"))] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert {f[0] for f in found(body(HEAD + item(b"") + pixels + END, b"3"))} == {None}
    assert found(body(dicom.packed(0x7FE00010, "OB", b"abcdef"))) == [(0, 0, b"ab"), (1, 0, b"cd"), (2, 0, b"ef")]
    assert found(body(b"")) == found(body(HEAD + END)) == found(body(HEAD + item(b"") + END)) == []


def test_files_that_break_off(spark, tmp_path):
    whole = body(HEAD + item(b"") + item(b"abcd") + END, b"1")
    for name, content in {"a": whole, "b": b"no", "c": whole[:-10], "d": whole[:150]}.items():
        (tmp_path / name).write_bytes(content)
    rows = dicom.read_fragments(spark, str(tmp_path))
    assert sorted((r["path"][-1], r["frame"]) for r in rows.collect()) == [("a", 0), ("b", None), ("c", None)]
    assert [(r["frame"], r["n_parts"], bytes(r["data"])) for r in dicom.read_frames(rows).collect()] == [(0, 1, b"abcd")]


@pytest.mark.parametrize("limits", [{}, {"SMALL": 0, "HELD_BYTES": 5}, {"HELD_FRAMES": 2}])
def test_whole_frames_without_a_shuffle(spark, tmp_path, monkeypatch, limits):
    """Files of every kind of table, large and small, broken and without frames: as fragments that are read and put together, in any size of what is held."""
    for name, value in limits.items():
        monkeypatch.setattr(dicom, name, value)
    pixels = b"".join(map(item, (b"aa", b"bbbb", b"cc", b"dddddd")))
    basic = body(HEAD + item(struct.pack("<3I", 0, 10, 32)) + pixels + END)
    contents = {"a": basic, "b": b"no", "c": basic[:-10], "d": basic[:150], "e": body(b""), "f": body(HEAD + item(b"") + END), "g": body(HEAD + item(b"") + pixels + END), "h": body(HEAD + item(b"") + pixels + END, b"1")}
    contents |= {"i": body(HEAD + item(b"") + pixels + END, b"4"), "j": body(dicom.packed(0x7FE00010, "OB", b"abcdef")), "k": body(HEAD + item(b"") + pixels + END, table=dicom.packed(0x7FE00001, "OV", struct.pack("<3Q", 0, 10, 32)))}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = sorted(map(tuple, dicom.read_frames(dicom.read_fragments(spark, str(tmp_path))).collect()))
    got = dicom.whole_frames(files.listing(spark, str(tmp_path)), ["path"])
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and {r[0][-1] for r in want} == set("ahijk") and len(want) == 3 + 1 + 4 + 3 + 3
    named = files.listing(spark, str(tmp_path)).filter("name = 'k'").select("path", "name", "length")
    assert sorted((r["name"], r["length"], r["frame"], bytes(r["data"])) for r in dicom.whole_frames(named, ["name", "length"]).collect()) == [("k", len(contents["k"]), i, d) for i, d in enumerate((b"aa", b"bbbbcc", b"dddddd"))]


def test_files_are_made_one_by_one():
    """A file is made of rows of several batches, and given out before rows of the next but one are taken."""
    frames = [("x", "basic", [b"a"]), ("x", "basic", [b"bb", b"ccc"]), ("x", "basic", [b""]), ("y", "extended", [b"dd", b"e"]), ("y", "extended", [b"ffff"]), ("z", None, [b"g"]), ("z", None, [b"hh"])]
    taken = []

    def batches():
        for k in range(0, len(frames), 2):
            taken.append(k)
            yield pa.record_batch({"name": [f[0] for f in frames[k : k + 2]], "tables": pa.array([f[1] for f in frames[k : k + 2]], pa.string()), "parts": pa.array([f[2] for f in frames[k : k + 2]], pa.list_(pa.binary()))})

    made = dicom.framed(batches())
    name, x = next(made)
    assert name == "x" and taken == [0, 2]
    found = lambda data: [(frame, part, data[at : at + n]) for frame, part, at, n in dicom.file_fragments(data)]
    assert found(x) == [(0, 0, b"a\0"), (1, 0, b"bb"), (1, 1, b"ccc\0"), (2, 0, b"")]
    assert [(name, found(data)) for name, data in made] == [("y", [(0, 0, b"dd"), (0, 1, b"e\0"), (1, 0, b"ffff")]), ("z", [(0, 0, b"g\0"), (1, 0, b"hh")])]


def test_frames_of_the_query_are_not_collected(spark):
    """No file's frames are one row, and the bytes of frames are not shuffled."""
    plan = formats.dicom_frames(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "collect_list" not in plan


def test_pieces_go_on_in_parts(spark, tmp_path, monkeypatch):
    """Places of several files, some missing, in batches of a few bytes."""
    monkeypatch.setattr(files, "READ_BYTES", 7)
    for name in ("a", "b"):
        (tmp_path / name).write_bytes(name.encode() * 40)
    rows = [(f"file:{tmp_path}/{n}", k) for k in range(9) for n in ("a", "gone", "b")] + [(None, 3), (f"file:{tmp_path}/a", None)]
    at = spark.createDataFrame(rows, "path string, k long").coalesce(1)
    got = files.read_at(at, F.col("k") * 4, F.lit(5))
    seen = sorted(((r["path"] or "-")[-1], -1 if r["k"] is None else r["k"], b"" if r["bytes"] is None else bytes(r["bytes"])) for r in got.collect())
    assert seen == sorted([("-", 3, b""), ("a", -1, b""), *(("e", k, b"") for k in range(9)), *((n, k, n.encode() * min(5, 40 - 4 * k)) for n in "ab" for k in range(9))])
