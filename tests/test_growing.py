"""Lines appended to files between two runs of a stream."""
import os

import pytest

from huntspark.sources import growing as G


def run(spark, folder, mark, out, **options):
    q = G.follow_lines(spark, str(folder), **options).writeStream.trigger(availableNow=True).option("checkpointLocation", str(mark)).format("parquet").option("path", str(out)).start()
    q.awaitTermination()
    rows = spark.read.schema(G.SCHEMA).parquet(str(out)).collect()
    return sorted(r.value for r in rows)


def add(path, text):
    with open(path, "a", newline="") as f:
        f.write(text)


@pytest.fixture
def place(tmp_path):
    os.mkdir(tmp_path / "in")
    return tmp_path / "in", tmp_path / "mark", tmp_path / "out"


def test_appended_lines_come_once(spark, place):
    folder, mark, out = place
    add(folder / "a.log", "a1\na2\nhalf")
    add(folder / "b.log", "b1\r\n\n")
    assert run(spark, *place) == ["", "a1", "a2", "b1"]
    assert run(spark, *place) == ["", "a1", "a2", "b1"]
    add(folder / "a.log", " line\na4\n")
    add(folder / "c.log", "c1\n")
    assert run(spark, *place) == ["", "a1", "a2", "a4", "b1", "c1", "half line"]
    add(folder / "c.log", "c2\nopen")
    assert run(spark, *place) == ["", "a1", "a2", "a4", "b1", "c1", "c2", "half line"]


def test_rotation_and_truncation(spark, place):
    folder, mark, out = place
    add(folder / "a.log", "first 1\nx\n")
    assert run(spark, *place, glob="a.log*") == ["first 1", "x"]
    add(folder / "a.log", "last of the old\n")
    os.rename(folder / "a.log", folder / "a.log.1")
    add(folder / "a.log", "first 2\n")
    add(folder / "other", "no\n")
    assert run(spark, *place, glob="a.log*") == ["first 1", "first 2", "last of the old", "x"]
    with open(folder / "a.log", "w") as f:
        f.write("first 3\n")
    assert run(spark, *place, glob="a.log*") == ["first 1", "first 2", "first 3", "last of the old", "x"]


@pytest.mark.parametrize("task_bytes,block", [(7, 5), (64, 1 << 20), (1, 3)])
def test_lines_are_cut_at_any_piece(spark, place, task_bytes, block, monkeypatch):
    folder, mark, out = place
    lines = ["x" * (i * 7 % 23) + str(i) for i in range(40)] + ["é漢" * 5, ""]
    add(folder / "a", "\n".join(lines) + "\n")
    monkeypatch.setattr(G, "BLOCK", block)
    reader = G.GrowingLines(str(folder), "*", False, task_bytes)
    pieces = reader.partitions({"files": {}}, reader.latestOffset())
    rows = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
    data = open(folder / "a", "rb").read()
    assert [r["value"] for r in rows] == lines and all(data[r["line_start"]:].startswith(r["value"].encode()) for r in rows)


def test_from_the_end_and_a_repeated_batch(spark, place):
    folder, mark, out = place
    add(folder / "a", "1\n2\n")
    reader = G.GrowingLines(str(folder), "*", True, 1 << 20)
    start = reader.initialOffset()
    add(folder / "a", "3\n")
    end = reader.latestOffset()
    pieces = reader.partitions(start, end)
    os.rename(folder / "a", folder / "b")  # between planning and reading
    assert [r["value"] for p in pieces for b in reader.read(p) for r in b.to_pylist()] == ["3"]
    os.remove(folder / "b")
    with pytest.raises(FileNotFoundError):
        list(reader.read(pieces[0]))
    assert reader.latestOffset() == {"files": {}}
