"""Files are written as a whole job or not at all."""

import json
import os

import pytest
from pyspark.sql import functions as F

from pixelgrove.sources import sink
from pixelgrove.sources.sink import FileSink, _Writer


def rows(spark, n):
    return spark.range(n).select(F.concat(F.lit("f"), "id", F.lit(".png")).alias("output_name"), F.encode(F.concat(F.lit("data"), "id"), "UTF-8").alias("bytes")).repartition(4)


def test_a_job_appears_whole_with_its_manifest(spark, tmp_path):
    spark.dataSource.register(FileSink)
    out = tmp_path / "out"
    for n in (20, 25):  # added to, files of the same name replaced
        rows(spark, n).write.format("file_sink").option("manifest", "true").mode("append").save(str(out))
    assert {p.name: p.read_bytes() for p in out.iterdir() if p.name[0] != "."} == {f"f{i}.png": f"data{i}".encode() for i in range(25)}
    hidden = sorted(p.name for p in out.iterdir() if p.name[0] == ".")
    assert len(hidden) == 2 and all(h.startswith(".manifest-") for h in hidden)
    assert sorted(len((out / h).read_text().splitlines()) for h in hidden) == [20, 25]
    assert {tuple(json.loads(x)) for h in hidden for x in (out / h).read_text().splitlines()} == {(f"f{i}.png", len(f"data{i}")) for i in range(25)}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(FileSink)
    out = tmp_path / "out"
    bad = rows(spark, 20).withColumn("output_name", F.when(F.col("output_name") == "f7.png", "../f7.png").otherwise(F.col("output_name")))
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("file_sink").mode("append").save(str(out))
    assert not out.exists() or os.listdir(out) == []
    for name in ("", "..", "a/b", "a\\b", ".names"):
        with pytest.raises(ValueError):
            _Writer(str(tmp_path), ["output_name", "bytes"]).write(iter([(name, b"x")]))


def test_an_attempt_that_ran_twice_counts_once(tmp_path):
    writer = _Writer(str(tmp_path / "out"), ["output_name", "bytes"], True)
    first, again = (writer.write(iter([("a.png", b"1"), ("b.png", b"22"), ("none.png", None)])) for _ in range(2))
    assert os.listdir(tmp_path / "out") == [f".staging-{writer.job}"] and (first.files, first.size) == (2, 3)
    writer.commit([again, None])
    assert sorted(os.listdir(tmp_path / "out")) == [f".manifest-{writer.job}", "a.png", "b.png"]
    other = _Writer(str(tmp_path / "out"), ["output_name", "bytes"])
    other.write(iter([("c.png", b"3")]))
    other.abort([])
    assert sorted(os.listdir(tmp_path / "out")) == [f".manifest-{writer.job}", "a.png", "b.png"]
    assert sink.FileSink.name() == "file_sink"
