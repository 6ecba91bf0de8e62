"""Stream queries over tables that are folders of part files, in several batches."""

import json
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from runledger.catalog import REGISTRY, Tables
from runledger.operators.extract import Rule, extract_values
from runledger.sources import logs as L
from runledger.streaming import live as V


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    for name in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


@pytest.mark.parametrize("name", ["extracted_stream", "status_stream", "bounded_status_stream", "bounded_extracted_stream"])
def test_folders_stream_in_batches(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "events"):
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    columns = [d[0] for d in con.execute(REGISTRY[name].sql).description]
    want = con.execute(REGISTRY[name].sql).fetchall()
    got = REGISTRY[name].run(Tables(spark, folder)).select(*columns).collect()
    assert len(want) > 5
    if not name.startswith("bounded"):  # with a delay, rows of a later file may be late
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    else:
        assert {r[0] for r in got} <= {r[0] for r in want} and got


def test_state_ends_and_late_rows_are_counted(spark, tmp_path):
    """One file a day of events, each day for other steps, and one late row in the last."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for day in range(1, 11):
        rows = [{"step": f"d{day}s{k}", "event": "finished", "ts": f"2024-01-{day:02d}T12:00:{k:02d}Z", "n": day * 100 + k} for k in range(20)]
        if day == 10:
            rows += [{"step": "late", "event": "started", "ts": "2024-01-01T00:00:00Z", "n": 1}]
        (source / f"{day:02d}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{day:02d}.json", (day, day))  # the order files are read in
    events = spark.readStream.schema("step string, event string, ts timestamp, n long").option("maxFilesPerTrigger", 1).json(str(source))
    live = V.status_stream(events, order=["ts", "n"], watermark=("ts", "1 hour"), span="1 day")
    stream = V.write_updates(live, out, str(tmp_path / "cp"), available_now=True)
    stream.awaitTermination()
    progress = [p["stateOperators"][0] for p in map(json.loads, (p.json for p in stream.recentProgress)) if p["stateOperators"]]
    held = [p["numRowsTotal"] for p in progress]
    assert max(held) <= 40 and held[-1] <= 40 < 200  # a span and the delay, not all steps
    assert sum(p["numRowsDroppedByWatermark"] for p in progress) == 1
    latest = V.read_latest(spark, out, ["step"], ["span"])
    assert latest.count() == 200 and latest.where("step = 'late'").isEmpty()
    before = sorted(map(repr, latest.collect()))
    for _ in range(2):
        V.compact_updates(spark, out, ["step"], ["span"])
        assert sorted(map(repr, V.read_latest(spark, out, ["step"], ["span"]).collect())) == before
    assert spark.read.parquet(out).select("batch_id").distinct().count() == 1


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in was:
        spark.conf.set(k, "300")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def whole_lines(text):
    return [*map(str, text.splitlines())]


def test_splits_number_lines_as_whole_files_do(spark, tmp_path, small_splits):
    rng = random.Random(4)
    breaks = ["\n"] * 6 + ["\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", "\u2028", "\n\n", "\r\r\n"]
    texts = {"empty": "", "one": "no break", "feed": "\n", "end": "a\nb\x0b", "cr": "a\r", "both": "a\x0b\n", "crlf": "a\r\n\r\nb\r\n", "uni": "é\u2028日本\n\u2029"}
    for i in range(6):
        texts[f"r{i}"] = "".join("x" * rng.randrange(40) + rng.choice(breaks) for _ in range(400)) + rng.choice(["", "tail", "tail\x0b", "\r"])
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    lines = L.read_log_lines(spark, str(tmp_path))
    assert L.split_lines(spark.read, str(tmp_path)).select("file", "block").distinct().count() > 50
    got = {}
    for r in lines.collect():
        got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.text
    for name, text in texts.items():
        assert got.get(name, {}) == dict(enumerate(whole_lines(text))), name


def test_split_lines_of_a_stream_are_in_order(spark, tmp_path, small_splits):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i in range(3):
        (source / f"{i}.log").write_text("\n".join(f"n = {k * (i + 1)}" if k % 7 == 0 else "x" * (k % 50) for k in range(2000)))
    rules = [Rule(r"n = (?P<n>\d+)", "n", "int")]
    stream = V.extract_values_stream(V.stream_split_lines(spark, str(source)), rules, ["file"], ["block", "place"])
    V.write_updates(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    take = lambda df: sorted((r.file, r.int_value) for r in df.collect())
    live = take(V.read_latest(spark, out, ["file", "field"]))
    assert live == take(extract_values(L.read_log_lines(spark, str(source)), rules, ["file"], ["line_no"])) and [v for _, v in live] == [1995, 3990, 5985]


def test_batches_follow_bytes_not_files(spark, folder):
    """Small part files are one batch."""
    from runledger.catalog import live

    frame = spark.read.parquet(f"{folder}/events.parquet")
    sizes = []
    stream = live._stream(Tables(spark, folder), "events", frame).writeStream.foreachBatch(lambda batch, _n: sizes.append(batch.count())).trigger(availableNow=True).start()
    stream.awaitTermination()
    assert sizes == [frame.count()]
