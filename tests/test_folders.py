import os
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import embed
from quarry.plans import store as stores
from quarry.plans.ingest import ingest
from quarry.sources.files import scan_folder
from quarry.sources.folders import Tree, contents, listed
from quarry.streaming import arrivals

SETTLE = 0.2


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_listing_equals_the_scan(spark, tmp_path):
    root = str(tmp_path / "docs")
    for k in range(40):
        write(f"{root}/{k % 3}/in ner {k % 5}/Ä{k}.md", f"# T{k}\n\nText {k}.\n")
    write(f"{root}/_under.md", "# U")
    write(f"{root}/.hidden.md", "# H")
    for options in ({}, {"least_folders": 1}, {"least_folders": 4, "files_a_part": 2}):
        rows = listed(spark, root, **options)
        found = {r["path"]: (r["length"], bytes(r["content"])) for r in contents(rows).collect()}
        scanned = {r["uri"]: (r["size_bytes"], bytes(r["content"])) for r in scan_folder(spark, root)[0].collect()}
        assert found == scanned and len(found) == 41
        assert rows.where("is_folder").count() == 1 + 3 + 15 and rows.count() == 41 + 19
        times = {r["path"]: r["modificationTime"].timestamp() for r in rows.where("NOT is_folder").collect()}
        assert all(abs(at - os.path.getmtime(path[5:])) < 1e-3 for path, at in times.items())
    assert listed(spark, root, include_hidden=True).where("NOT is_folder").count() == 42
    os.mkdir(tmp_path / "none")
    assert [r["is_folder"] for r in listed(spark, str(tmp_path / "none")).collect()] == [True]
    with pytest.raises(NotADirectoryError):
        listed(spark, str(tmp_path / "missing"))


def test_files_that_are_gone_are_not_given(spark, tmp_path):
    root = str(tmp_path)
    for k in range(3):
        write(f"{root}/{k}.md", "x" * k)
    rows = spark.createDataFrame(listed(spark, root).collect(), "path string, modificationTime timestamp, length long, is_folder boolean")
    os.remove(f"{root}/1.md")
    assert sorted(r["length"] for r in contents(rows).collect()) == [0, 2]
    assert contents(rows.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), max_size=4), max_size=12), st.integers(1, 6), st.integers(1, 4))
def test_parts_give_each_file_once(tmp_path_factory, places, least, share):
    root = str(tmp_path_factory.mktemp("tree"))
    for k, place in enumerate(places):
        write("/".join([root, *place, f"f{k}"]), "x")
    tree = Tree({"path": root, "least_folders": str(least), "files_a_part": str(share)})
    rows = [r for part in tree.parts() for r in tree.read(part)]
    wanted = [os.path.join(at, name) for at, _, files in os.walk(root) for name in files] + [at for at, _, _ in os.walk(root)]
    assert sorted(r[0] for r in rows) == sorted(wanted)


def test_the_driver_lists_no_more_than_the_upper_folders(tmp_path, monkeypatch):
    for a in range(5):
        for b in range(5):
            write(f"{tmp_path}/{a}/{b}/x.md", "x")
    tree, seen = Tree({"path": str(tmp_path), "least_folders": "5"}), []
    below = tree._below
    monkeypatch.setattr(tree, "_below", lambda folder: seen.append(folder) or below(folder))
    parts = tree.parts()
    assert seen == [str(tmp_path)] and sum(p.deep for p in parts) == 5


def test_changes_follow_edits_and_deletions(spark, tmp_path):
    root, where, embedder = str(tmp_path / "docs"), str(tmp_path / "checkpoint"), embed.HashEmbedder()
    store = stores.Store(spark, str(tmp_path / "store"))

    def step():
        time.sleep(2 * SETTLE)
        arrivals.ingest_changes(spark, store, root, embedder, where, settle=SETTLE, least_folders=2).awaitTermination()
        return {r["title"] for r in store.read("index").collect()}

    for name in ("one", "two", "in/three", "in/deep/four"):
        write(f"{root}/{name}.md", f"# {name}\n\nThe text of {name}.\n")
    write(f"{root}/notes.bin", "no")
    assert step() == {"one", "two", "in/three", "in/deep/four"}
    version = {r["title"]: r["updated_at"] for r in store.read("documents").select("title", "updated_at").collect()}
    write(f"{root}/two.md", "# second\n\nEdited in place.\n")  # its folder's time stays
    assert step() == {"one", "second", "in/three", "in/deep/four"}
    after = {r["title"]: r["updated_at"] for r in store.read("documents").select("title", "updated_at").collect()}
    assert after["one"] == version["one"] and after["in/three"] == version["in/three"]  # what didn't change wasn't indexed again
    os.remove(f"{root}/one.md")
    assert step() == {"second", "in/three", "in/deep/four"}
    os.rename(f"{root}/in", f"{tmp_path}/elsewhere")  # a whole folder goes
    write(f"{root}/new.md", "# new\n\nCame last.\n")
    assert step() == {"second", "new"}
    assert step() == {"second", "new"}
    report = ingest(spark, store, root, embedder)  # the plan finds nothing left to do
    assert (report["unchanged"], report["to_index"], report["pruned"]) == (2, 0, 0)
