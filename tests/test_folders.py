"""Folders: what is walked, what is opened, and how much of it is read."""

import json
import os

from pixelgrove.functions import geometry as g
from pixelgrove.operators import process
from pixelgrove.sources import folders, images

from .test_images import png


def jpeg(width, height, behind):
    """A JPEG's beginning whose size stands behind so many bytes of segments."""
    out = b"\xff\xd8"
    while behind > 0:
        n = min(behind, 60_000)
        out += b"\xff\xe1" + (n + 2).to_bytes(2, "big") + b"x" * n
        behind -= n
    return out + b"\xff\xc0\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + b"\x03" + b"\0" * 9 + b"\xff\xda" + b"\0" * 500_000


def build(root):
    (root / "a" / "b").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "a" / "one.png").write_bytes(png(24, 16) + b"\0" * 300_000)
    (root / "a" / "b" / "two.jpg").write_bytes(jpeg(640, 480, 200_000))
    (root / "a" / ".x.png").write_bytes(png(4, 4))
    (root / ".hidden" / "y.png").write_bytes(png(4, 4))
    (root / "notes.txt").write_bytes(b"n" * 100_000)
    (root / "odd +%41.png").write_bytes(png(5, 6))
    os.symlink(root / "a", root / "again")
    os.symlink(root / "a" / "one.png", root / "linked.png")
    os.mkfifo(root / "pipe.png")


def test_plan_reads_heads_only_and_follows_no_link(spark, tmp_path):
    build(tmp_path)
    plan = {r["name"]: r for r in images.folder_plan(spark, str(tmp_path)).collect()}
    assert set(plan) == {"one.png", "two.jpg", "notes.txt", "odd +%41.png"}
    assert {k: r["verdict"] for k, r in plan.items()} == {"one.png": "ready", "two.jpg": "ready", "notes.txt": "not_listed", "odd +%41.png": "ready"}
    assert (plan["two.jpg"]["width"], plan["two.jpg"]["height"]) == (640, 480) and plan["two.jpg"]["bytes"] > 700_000
    assert plan["one.png"]["bytes_read"] == 4096 and 4096 < plan["two.jpg"]["bytes_read"] < 4200 and plan["notes.txt"]["bytes_read"] == 0
    # What the plan leaves out is not opened either.
    assert [(r["name"], r["bytes_read"] < 4200) for r in images.folder_plan(spark, str(tmp_path), entries=1).collect()] == [("two.jpg", True)]


def test_walk_is_the_same_in_any_number_of_partitions(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"d{i % 5}" / f"e{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"d{i % 5}" / f"e{i % 3}" / f"f{i}.gif").write_bytes(b"GIF89a")
    want = sorted(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs)
    for parts in (1, 3, 7, 100):
        found = folders.tree(spark, str(tmp_path), parts=parts)
        assert found.rdd.getNumPartitions() <= parts and sorted(r["path"] for r in found.collect()) == want
    twice = folders.tree(spark, [str(tmp_path), str(tmp_path / "d1"), "file://" + str(tmp_path)])
    assert sorted(r["path"] for r in twice.collect()) == want
    one = folders.tree(spark, str(tmp_path / "d0" / "e0" / "f0.gif")).collect()
    assert [(r["name"], r["bytes"], r["depth"]) for r in one] == [("f0.gif", 6, 0)]


def test_problems_have_sentences(spark, tmp_path):
    deep = tmp_path / "1/2/3/4/5/6/7/8"
    deep.mkdir(parents=True)
    (deep / "low.png").write_bytes(png(4, 4))
    for i in range(4):
        (tmp_path / f"{i}.png").write_bytes(png(4, 4))
    gone = str(tmp_path / "gone")
    found = {r["problem"]: (r["sentence"], r["files"]) for r in images.folder_problems(spark, [str(tmp_path), gone], entries=3).collect()}
    assert found == {
        "too_deep": ("stopped 8 levels down: it is deeper than any folder can usefully be, and the rest of it was not looked at", 1),
        "not_found": (f"could not look at {gone}: it may have moved, or this device will not let the app read it", 1),
        "too_many_entries": ("stopped after 3 files; the rest of this folder was not looked at", 1),
    }

    def closed(path):
        raise PermissionError(13, "Permission denied")

    assert folders.look(str(tmp_path), 0, 8, closed) == ((str(tmp_path), tmp_path.name, None, 0, f"could not open {tmp_path}: Permission denied"), [])
    (tmp_path / "empty").mkdir()
    assert folders.tree(spark, str(tmp_path / "empty")).count() == 0
    with open(os.fsencode(tmp_path / "empty") + b"/\xff.png", "wb") as f:
        f.write(b"x")
    assert "its name is not text" in folders.tree(spark, str(tmp_path / "empty")).first()["problem"]


def test_reader_plans_branches_without_walking_them(tmp_path):
    for i in range(30):
        (tmp_path / f"d{i}" / "inner").mkdir(parents=True)
        (tmp_path / f"d{i}" / "inner" / "x.png").write_bytes(b"1")
    reader = folders._Reader({"roots": json.dumps([str(tmp_path)]), "parts": "4"})
    parts = reader.partitions()
    assert len(parts) == 4 and all(p.endswith(tuple(f"d{i}" for i in range(30))) for q in parts for p, _ in q.paths)
    assert sum(1 for q in parts for _ in reader.read(q)) == 30


def test_more_files_than_a_plan_has_by_default_can_be_asked_for(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"p{i}.png").write_bytes(png(24, 16, i))
    out = process.process_folder(spark, str(tmp_path), g.Resize(12, 12, "contain"), entries=4)
    assert out.count() == 4 and process.process_folder(spark, str(tmp_path), g.Resize(12, 12, "contain"), entries=6).filter("bytes IS NOT NULL").count() == 6
