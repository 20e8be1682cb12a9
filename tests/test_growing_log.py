"""Logs that are still written to: every ended line once and in order, through growth, rotation and restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from faultline.sources.growing_log import GrowingLog, _Growing
from faultline.streaming import follow


def _reader(folder, **options):
    return _Growing({"path": str(folder), **options})


def _read(reader, start, end):
    return [bytes(v.as_py()) for part in reader.partitions(start, end) for batch in reader.read(part) for v in batch.column("value")]


def _append(path, data):
    with open(path, "ab") as file:
        file.write(data)


def test_lines_come_when_they_are_ended(tmp_path):
    log, reader = tmp_path / "app.log", _reader(tmp_path)
    assert reader.latestOffset() == {} == _reader(tmp_path / "missing").latestOffset()
    _append(log, b"one\ntwo\nthr")
    first = reader.latestOffset()
    assert _read(reader, {}, first) == [b"one", b"two"]
    assert reader.latestOffset() == first
    _append(log, b"ee")
    assert reader.latestOffset() == first and _read(reader, first, first) == []
    _append(log, b"\n\n \r\nfour\rfive\n")
    second = reader.latestOffset()
    assert _read(reader, first, second) == [b"three", b" ", b"four", b"five"]
    # a new reader after a restart, and one that reads the range again
    assert _reader(tmp_path).latestOffset().keys() == second.keys()
    assert _read(_reader(tmp_path), first, second) == [b"three", b" ", b"four", b"five"]


def test_rotation_by_renaming(tmp_path):
    log, reader = tmp_path / "app.log", _reader(tmp_path, glob="app.log*")
    _append(log, b"a1\na2\n")
    _append(tmp_path / "other.txt", b"no\n")
    first = reader.latestOffset()
    _append(log, b"a3\n")
    os.rename(log, tmp_path / "app.log.1")
    _append(log, b"b1\n")
    second = reader.latestOffset()
    assert sorted(_read(reader, first, second)) == [b"a3", b"b1"]
    os.rename(tmp_path / "app.log.1", tmp_path / "app.log.2")
    os.rename(log, tmp_path / "app.log.1")
    _append(tmp_path / "app.log.1", b"b2\n")
    _append(log, b"c1\n")
    third = reader.latestOffset()
    assert sorted(_read(reader, second, third)) == [b"b2", b"c1"]
    # ranges planned before a rotation are found after it
    assert sorted(_read(reader, first, second)) == [b"a3", b"b1"]


def test_files_cut_and_copied(tmp_path):
    log, reader = tmp_path / "app.log", _reader(tmp_path)
    _append(log, b"a1\na2\n")
    first = reader.latestOffset()
    _append(log, b"a3\n")
    (tmp_path / "app.log.1").write_bytes(log.read_bytes())
    log.write_bytes(b"")
    second = reader.latestOffset()
    assert _read(reader, first, second) == [b"a3"]
    _append(log, b"b1, longer than before\n")
    third = reader.latestOffset()
    assert _read(reader, second, third) == [b"b1, longer than before"]
    log.write_bytes(b"c1\n")
    fourth = reader.latestOffset()
    assert _read(reader, third, fourth) == [b"c1"]


def test_bytes_that_are_gone(tmp_path):
    log = tmp_path / "app.log"
    _append(log, b"a1\n")
    reader = _reader(tmp_path)
    end = reader.latestOffset()
    log.unlink()
    with pytest.raises(FileNotFoundError, match="gone"):
        reader.partitions({}, end)
    assert _reader(tmp_path, failOnDataLoss="FALSE").partitions({}, end) == []


@pytest.mark.parametrize("split", [1, 2, 3, 7, 64, 1000])
def test_splits_cut_at_line_ends(tmp_path, split):
    draw = random.Random(split)
    lines = [b"x" * draw.choice([0, 1, 2, 5, 30]) + str(i).encode() for i in range(60)]
    _append(tmp_path / "app.log", b"\n".join(lines) + b"\n")
    reader = _reader(tmp_path, splitBytes=str(split))
    parts = reader.partitions({}, reader.latestOffset())
    got = [(v.as_py(), s.as_py()) for p in parts for b in reader.read(p) for v, s in zip(b.column("value"), b.column("start"), strict=True)]
    assert [v for v, _ in got] == lines
    data = (tmp_path / "app.log").read_bytes()
    assert all(data[s:s + len(v)] == v for v, s in got)


def test_any_history_gives_every_line_once(tmp_path):
    """Random growth in pieces that ignore line ends, with rotations and restarts between looks."""
    draw = random.Random(11)
    log, written, got, start, n, files = tmp_path / "app.log", [], [], {}, 0, 0
    pending = b""
    for _ in range(120):
        for _ in range(draw.randrange(4)):
            line = f"line {n} ".encode() + b"y" * draw.choice([0, 3, 400, 3000])
            n += 1
            written.append(line)
            pending += line + draw.choice([b"\n", b"\r\n"])
        cut = draw.randrange(len(pending) + 1)
        _append(log, pending[:cut])
        pending = pending[cut:]
        if draw.random() < 0.1:
            _append(log, pending)
            pending = b""
            files += 1
            os.rename(log, tmp_path / f"app.log.{files}")
        if draw.random() < 0.7:
            reader = _reader(tmp_path, splitBytes=str(draw.choice([100, 10_000])))
            end = reader.latestOffset()
            got += _read(reader, start, end)
            start = end
    _append(log, pending)
    reader = _reader(tmp_path)
    got += _read(reader, start, reader.latestOffset())
    assert sorted(got) == sorted(written)


def _follow(spark, folder, bronze, checkpoint):
    lines = follow.follow_growing(spark, str(folder), split_bytes=64)
    query = follow.write_bronze_stream(lines, str(bronze), str(checkpoint))
    assert query.awaitTermination(120), query.lastProgress
    rows = spark.read.schema(follow.RAW_SCHEMA).parquet(f"{bronze}/load=*")
    return [r.payload for r in rows.orderBy("seq").collect()]


def test_stream_with_restarts_equals_batch(spark, tmp_path):
    folder, log = tmp_path / "logs", tmp_path / "logs" / "app.log"
    folder.mkdir()
    lines = [f'{{"i": {i}, "text": "{"é" * (i % 40)}"}}' for i in range(300)]
    data, at = "\n".join(lines).encode() + b"\n", 0
    for cut in (1000, 1003, 1003, 5000, len(data)):
        _append(log, data[at:cut])
        at = cut
        got = _follow(spark, folder, tmp_path / "bronze", tmp_path / "checkpoint")
        whole = data[:cut].rfind(b"\n") + 1
        assert got == data[:whole].decode().split("\n")[:-1]
    _append(log, b"an unfinished line")
    assert _follow(spark, folder, tmp_path / "bronze", tmp_path / "checkpoint") == lines
    spark.dataSource.register(GrowingLog)
    batch = spark.read.format("growing_log").option("splitBytes", 50).load(str(folder)).orderBy("start")
    assert [bytes(r.value).decode() for r in batch.collect()] == [*lines, "an unfinished line"]
    assert batch.select(F.count_if(F.col("modified") > "2020-01-01"), F.count_distinct("file")).first()[:] == (301, 1)


def test_lines_appended_while_the_stream_runs(spark, tmp_path):
    log = tmp_path / "app.log"
    _append(log, b'{"i": 1}\n')
    query = follow.write_bronze_stream(
        follow.follow_growing(spark, str(log)), str(tmp_path / "bronze"), str(tmp_path / "checkpoint"), interval="0 seconds")
    try:
        query.processAllAvailable()
        _append(log, b'{"i": 2}\n{"i"')
        query.processAllAvailable()
        _append(log, b": 3}\n")
        query.processAllAvailable()
    finally:
        query.stop()
    rows = spark.read.schema(follow.RAW_SCHEMA).parquet(f"{tmp_path}/bronze/load=*").orderBy("seq").collect()
    assert [r.payload for r in rows] == ['{"i": 1}', '{"i": 2}', '{"i": 3}']
