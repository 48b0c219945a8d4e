"""The file stream: what the driver holds of its files, and that it reads those that Spark's own file stream would read."""

import os
import tracemalloc

import pytest

from siftmill.operators import models
from siftmill.sources import files as fl
from siftmill.sources.index import Index
from siftmill.streaming import file_ingest
from siftmill.streaming.file_ingest import stream_files


def write(root, **content):
    for name, text in content.items():
        path = root / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def go(spark, folder, index, tmp_path, **more):
    stream_files(spark, str(folder), index, models.HashEmbedder(4), str(tmp_path / "cp"), **more).awaitTermination(120)


def shas(index):
    return {r["file_path"]: r["source_sha"] for r in index.file_shas().collect()}


def test_the_driver_holds_no_file_names(spark, tmp_path):
    folder, index = tmp_path / "in", Index(spark, str(tmp_path / "idx"))
    write(folder, **{f"f{k}.md": f"text {k}" for k in range(300)})
    go(spark, folder, index, tmp_path)
    assert index.file_shas().count() == 300
    # A stream's log of its files, which the driver holds, has a line for each.
    logged = [line for d, _, names in os.walk(tmp_path / "cp") if "sources" in d for n in names if not n.startswith(".") for line in open(f"{d}/{n}")]
    assert 0 < len(logged) <= 64


def test_opening_a_folder_holds_folders_alone(tmp_path):
    write(tmp_path, **{"sub__a.md": "a"})
    for k in range(5000):
        (tmp_path / f"file-{k}.md").touch()
    tracemalloc.start()
    found = fl.NamesReader(str(tmp_path), 64).partitions()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(p.rel, p.whole) for p in found] == [("", False), ("sub", False)] and peak < 300_000


def test_files_are_those_of_sparks_stream(spark, tmp_path):
    folder = tmp_path / "in"
    write(folder, **{"a.md": "a", "B.Md": "b", "void.md": "", ".h.md": "h", "_u.md": "u", "_k=1.md": "k", "_metadata__m.md": "m", "_metadata.md": "m", ".d__x.md": "x", "_d__x.md": "x", "out__x.md": "x", "c d__e%20#__f.md": "f", "n.txt": "n"})
    write(tmp_path / "else", **{"l.md": "l"})
    (folder / "linked").symlink_to(tmp_path / "else")
    (folder / "l.md").symlink_to(folder / "a.md")
    mine, theirs = (Index(spark, str(tmp_path / n)) for n in ("mine", "theirs"))
    go(spark, folder, mine, tmp_path, ignore=["out/**"])
    file_ingest._own_stream(spark, str(folder), theirs, models.HashEmbedder(4), str(tmp_path / "cp2"), file_ingest.Chunking(), ["out/**"], None).awaitTermination(120)
    assert shas(mine) == shas(theirs) and {"linked/l.md", "_k=1.md", "l.md", "c d/e%20#/f.md"} <= shas(mine).keys()
    # A link that leads back is not entered.
    (folder / "linked" / "back").symlink_to(folder)
    (folder / "linked" / "self").symlink_to(tmp_path / "else")
    assert {r["path"] for r in fl.list_names(spark, str(folder), 1).collect()} == shas(mine).keys() | {"out/x.md"}


def test_a_later_call_reads_what_came_or_changed(spark, tmp_path):
    folder, index = tmp_path / "in", Index(spark, str(tmp_path / "idx"))
    write(folder, **{"a.md": "a", "b.md": "b", "void.md": ""})
    go(spark, folder, index, tmp_path)
    first = shas(index)
    last = index.log.last()
    go(spark, folder, index, tmp_path)
    assert index.log.last() == last and first.keys() == {"a.md", "b.md"}
    write(folder, **{"b.md": "new", "void.md": "no more", "sub__c.md": "c"})
    go(spark, folder, index, tmp_path)
    assert shas(index).keys() == {"a.md", "b.md", "void.md", "sub/c.md"} and shas(index)["b.md"] != first["b.md"] and shas(index)["a.md"] == first["a.md"]


def test_a_failed_batch_is_repeated(spark, tmp_path):
    class Broken:
        def embed(self, texts, kind):
            raise models.ModelError("down")

    folder, index = tmp_path / "in", Index(spark, str(tmp_path / "idx"))
    write(folder, **{"a.md": "a", "b.md": "b"})
    with pytest.raises(Exception, match="down"):
        go(spark, folder, index, tmp_path, sparse=Broken())
    write(folder, **{"c.md": "c"})
    (folder / "b.md").unlink()
    go(spark, folder, index, tmp_path)
    assert shas(index).keys() == {"a.md", "c.md"}
