"""Claims of a stream: a later copy is reported with the first, also after a restart."""

import os

from pyspark.sql import functions as F

from pixelgrove.operators.batch import content_key
from pixelgrove.streaming.folder import claims


def drain(spark, root, out, state, trigger):
    q = claims(spark, root, files_per_trigger=trigger).writeStream.format("parquet").option("checkpointLocation", state).option("path", out).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {r["name"]: r["of"] for r in spark.read.parquet(out).collect()}


def put(root, at, **files):
    for name, content in files.items():
        path = root / f"{name}.png"
        path.write_bytes(content)
        os.utime(path, (at, at))
        at += 1


def test_claims_outlive_a_restart(spark, tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    # Empty files (e, f) do not come out of the file source.
    put(root, 1_000, a=b"\x89PNG one", b=b"\x89PNG one", c=b"two", e=b"", f=b"")
    assert drain(spark, str(root), out, state, 100) == {"a.png": None, "b.png": "a.png", "c.png": None}
    put(root, 2_000, d=b"two", g=b"three", h=b"three", i=b"\x89PNG one")
    got = drain(spark, str(root), out, state, 2)
    assert got == {"a.png": None, "b.png": "a.png", "c.png": None, "d.png": "c.png", "g.png": None, "h.png": "g.png", "i.png": "a.png"}
    rows = spark.read.parquet(out)
    assert rows.count() == 7 and drain(spark, str(root), out, state, 2) == got and spark.read.parquet(out).count() == 7
    key = spark.range(1).select(content_key(F.lit(b"two"), "").alias("k")).first()["k"]
    assert {r["key"] for r in rows.filter("name IN ('c.png', 'd.png')").collect()} == {key}
