"""Markdown files under one or several roots, and incremental conversion of PDF files."""

from __future__ import annotations

import hashlib
import json
import os
import re
import stat
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def distinct_roots(*paths: str | None) -> list[str]:
    """Roots in their order, each once, without empty ones."""
    return [p for p in dict.fromkeys(paths) if p]


def glob_regex(pattern: str) -> str | None:
    """A glob over a relative path as an anchored regular expression; None for a malformed one, which matches nothing.

    * and ? do not cross a slash, [...] is a class, a backslash quotes. `dir/**` matches whatever lies under dir at the
    root (besides what it matches as a glob).
    """
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            k += 1
            if k == len(pattern):
                return None
            out += re.escape(pattern[k])
        elif c == "[":
            end = pattern.find("]", k + 2 if pattern[k + 1 : k + 2] != "^" else k + 3)
            if end < 0:
                return None
            body = pattern[k + 1 : end]
            sign, body = ("^", body[1:]) if body.startswith("^") else ("", body)
            out += f"[{sign}" + body.replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&") + "]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    glob = f"^{out}$"
    return f"^{re.escape(pattern[:-3])}/|{glob}" if pattern.endswith("/**") else glob


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path, or one of the directories above it (written with a slash), matches a pattern."""
    regexes = [r for r in map(glob_regex, patterns) if r]
    if not regexes:
        return F.lit(False)
    parts = F.split(path, "/")
    dirs = F.transform(F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: k > 0), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    tested = F.concat(F.array(path), dirs)
    return F.exists(tested, lambda p: F.array_contains(F.array(*[p.rlike(r) for r in regexes]), True))


def relative_path(spark: SparkSession, path: Column, root: str) -> Column:
    """What Spark calls a file below `root`, relative to it, whatever characters the names have."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(re.sub(r"(?<=.)/+$", "", root))
    fs = folder.getFileSystem(conf)
    whole = folder.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(whole)), F.substring(path, F.lit(len(whole) + 1), F.length(path))).otherwise(path)


def qualified(spark: SparkSession, root: str) -> str:
    """A folder as Spark finds it: the path of a local one, the URI of others."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(re.sub(r"(?<=.)/+$", "", root))
    fs = folder.getFileSystem(conf)
    uri = folder.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri()
    return uri.getPath() if uri.getScheme() == "file" else uri.toString()


@dataclass
class Entry:
    """A folder or file of a `Tree`: its path from the root, and what the store says of it."""

    path: str
    folder: bool
    held: object

    def stat(self) -> tuple[int, int] | None:
        """Bytes and time of change (ns) of a file; None if it is no file any more."""
        if hasattr(self.held, "mtime_ns"):
            return (self.held.size, self.held.mtime_ns or 0) if self.held.is_file else None
        try:
            found = self.held.stat()
        except FileNotFoundError:
            return None
        return (found.st_size, found.st_mtime_ns) if stat.S_ISREG(found.st_mode) else None


class Tree:
    """The files below a folder: a local or mounted one by its path, others by a URI that pyarrow knows."""

    def __init__(self, root: str):
        if root.startswith("file:"):
            root = unquote(urlparse(root).path)
        self.local = "://" not in root
        if self.local:
            self.root = os.path.abspath(root)
        else:
            from pyarrow import fs

            self.fs, self.base = fs.FileSystem.from_uri(root)
            self.root = root.rstrip("/")

    def absolute(self, rel: str) -> str:
        return f"{self.root.rstrip('/')}/{rel}"

    def entries(self, rel: str, links: bool = False) -> Iterator[Entry]:
        """What lies directly in a folder, one after the other. Links to folders are not followed, or with `links` those that do not lead back above themselves; the others count as files."""
        head = f"{rel}/" if rel else ""
        if self.local:
            with os.scandir(os.path.join(self.root, rel)) as found:
                for e in found:
                    path = head + e.name
                    yield Entry(path, e.is_dir(follow_symlinks=False) or links and e.is_dir() and not self._leads_back(path), e)
        else:
            from pyarrow import fs

            for i in self.fs.get_file_info(fs.FileSelector(f"{self.base}/{rel}".rstrip("/"))):
                yield Entry(head + i.base_name, i.type == fs.FileType.Directory, i)

    def _leads_back(self, rel: str) -> bool:
        parts = rel.split("/")
        real = os.path.realpath(os.path.join(self.root, rel))
        return any(os.path.realpath(os.path.join(self.root, *parts[:k])) == real for k in range(len(parts)))

    def children(self, rel: str) -> tuple[list[str], list[str]]:
        """Folders and files directly in a folder, as paths from the root; links to folders are not followed."""
        found = sorted(self.entries(rel), key=lambda e: e.path)
        return [e.path for e in found if e.folder], [e.path for e in found if not e.folder]

    def write(self, rel: str, data: bytes) -> None:
        if ".." in rel.split("/") or rel.startswith("/"):
            raise ValueError(f"{rel} is not below the root")
        folder, name = os.path.split(f"{self.root if self.local else self.base}/{rel}")
        mine = f"{folder}/.{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(folder, exist_ok=True)
            with open(mine, "wb") as f:
                f.write(data)
            os.replace(mine, f"{folder}/{name}")
        else:
            self.fs.create_dir(folder, recursive=True)
            with self.fs.open_output_stream(mine) as f:
                f.write(data)
            self.fs.move(mine, f"{folder}/{name}")

    def read(self, rel: str) -> bytes:
        if self.local:
            with open(os.path.join(self.root, rel), "rb") as f:
                return f.read()
        with self.fs.open_input_stream(f"{self.base}/{rel}") as f:
            return f.read()


def write_files(rows: DataFrame, root: str) -> int:
    """Writes rows (path, content) as files below `root`, each from the task that has it; their number.

    A file appears under its name when it is whole, so that a task that is run again changes nothing. A path that leaves the
    root is an error.
    """

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                tree.write(path, bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", F.col("content").cast("binary").alias("content")).mapInPandas(each, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


LISTED = "path string, root string, absolute string, sha string, content string"


@dataclass
class Folder(InputPartition):
    root: str
    rel: str
    whole: bool


class MarkdownFiles(DataSource):
    """The .md files below some roots as a table, for `spark.read.format("markdown_files")`.

    Options: `roots` and `ignore`, JSON lists; `folders`, the number of partitions to aim at. Folders are dealt to tasks, which
    walk what is below them; ignored folders are not entered, and of files only those that are listed are read.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema: object) -> DataSourceReader:
        return MarkdownReader(json.loads(self.options["roots"]), json.loads(self.options.get("ignore", "[]")), int(self.options.get("folders", "64")))


class MarkdownReader(DataSourceReader):
    def __init__(self, roots: list[str], ignore: list[str], folders: int):
        self.roots, self.folders = roots, folders
        self.patterns = [re.compile(r) for r in map(glob_regex, ignore) if r]

    def _out(self, rel: str) -> bool:
        return any(p.search(rel) for p in self.patterns)

    def partitions(self) -> list[InputPartition]:
        """Folders are opened breadth first until there are enough of them; those that were opened leave their own files."""
        waiting = deque((r, "") for r in self.roots if not self._out("./"))
        opened: list[InputPartition] = []
        while waiting and len(waiting) + len(opened) < self.folders:
            root, rel = waiting.popleft()
            opened.append(Folder(root, rel, False))
            waiting.extend((root, d) for d in sorted(e.path for e in Tree(root).entries(rel) if e.folder) if not self._out(d + "/"))
        return opened + [Folder(root, rel, True) for root, rel in waiting]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in where there are none
            return
        tree, waiting = Tree(partition.root), deque([partition.rel])
        while waiting:
            folders, found = tree.children(waiting.popleft())
            if partition.whole:
                waiting.extend(d for d in folders if not self._out(d + "/"))
            for rel in found:
                if os.path.splitext(f"x{os.path.basename(rel)}")[1].lower() == ".md" and not self._out(rel):
                    try:
                        data = tree.read(rel)
                        yield rel, tree.root, tree.absolute(rel), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")
                    except OSError:
                        yield rel, tree.root, tree.absolute(rel), "", None


def list_markdown(spark: SparkSession, roots: list[str], ignore: list[str] = (), folders: int = 64) -> DataFrame:
    """path (relative), root, absolute, sha, content of the .md files under the roots; their extension may be in any case.

    Two roots may hold the same relative path; both rows are listed. Files of length 0 are listed as well, and hidden
    ones. A file that can't be read has an empty hash and no content; a root that can't be is an error.
    """
    spark.dataSource.register(MarkdownFiles)
    reader = spark.read.format("markdown_files").option("roots", json.dumps(distinct_roots(*roots))).option("ignore", json.dumps(list(ignore)))
    return reader.option("folders", str(folders)).load()



NAMES = "path string, bytes long, modified long"
#: Rows of a listing that make a task of their own, and bytes of files.
READ_FILES, READ_BYTES = 2_000, 32 << 20


class MarkdownNames(DataSource):
    """What Spark's own reader would list of the .md files below a folder, by names alone, for `spark.read.format("markdown_names")`.

    Options: `root`; `folders`, the number of partitions to aim at. Names that begin with . or _ are left out, and files of length
    0. Neither the driver nor a task holds the names that it finds: the driver opens folders until there are enough of them, and
    holds these alone.
    """

    @classmethod
    def name(cls) -> str:
        return "markdown_names"

    def schema(self) -> str:
        return NAMES

    def reader(self, schema: object) -> DataSourceReader:
        return NamesReader(self.options["root"], int(self.options.get("folders", "64")))


class NamesReader(DataSourceReader):
    def __init__(self, root: str, folders: int):
        self.root, self.folders = root, folders

    def _entries(self, tree: Tree, rel: str) -> Iterator[Entry]:
        for e in tree.entries(rel, links=True):
            name = os.path.basename(e.path)
            if not name.startswith(".") and (not name.startswith("_") or "=" in name or e.folder and name.startswith(("_metadata", "_common_metadata"))):
                yield e

    def partitions(self) -> list[InputPartition]:
        tree, waiting = Tree(self.root), deque([""])
        opened: list[InputPartition] = []
        while waiting and len(waiting) + len(opened) < self.folders:
            opened.append(Folder(self.root, waiting.popleft(), False))
            waiting.extend(e.path for e in self._entries(tree, opened[-1].rel) if e.folder)
        return opened + [Folder(self.root, rel, True) for rel in waiting]

    def read(self, partition: Folder | None) -> Iterator[tuple]:
        if partition is None:
            return
        tree, waiting = Tree(partition.root), deque([partition.rel])
        while waiting:
            for e in self._entries(tree, waiting.popleft()):
                if e.folder:
                    if partition.whole:
                        waiting.append(e.path)
                elif e.path[-3:].lower() == ".md" and (held := e.stat()) and held[0]:
                    yield e.path, *held


def lists_names(root: str) -> bool:
    """Whether a folder lies in a store that tasks can list."""
    try:
        Tree(root)
        return True
    except (pa.ArrowInvalid, OSError):
        return False


def list_names(spark: SparkSession, root: str, folders: int = 64) -> DataFrame:
    """path (relative), bytes, modified (ns) of the .md files below a folder that are neither hidden nor empty; no file is opened."""
    spark.dataSource.register(MarkdownNames)
    return spark.read.format("markdown_names").option("root", root).option("folders", str(folders)).load()


def read_names(names: DataFrame, root: str) -> DataFrame:
    """path, sha, content of files below `root` by their names, read in tasks that get about READ_FILES or READ_BYTES. Files that are gone are left out."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, held, size = Tree(root), [], 0
        for batch in batches:
            for path in batch["path"]:
                try:
                    data = tree.read(path)
                except FileNotFoundError:
                    continue
                held.append((path, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace")))
                size += len(data)
                if size >= READ_BYTES // 8:
                    yield pd.DataFrame(held, columns=["path", "sha", "content"])
                    held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["path", "sha", "content"])

    n, size = names.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, -(-n // READ_FILES), -(-size // READ_BYTES), min(n, names.sparkSession.sparkContext.defaultParallelism))
    return names.select("path").repartition(tasks).mapInPandas(each, "path string, sha string, content string")


def fetch_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Content of the wanted files, from the rows that the listing has read already.

    With a `root` on both sides, equal paths under different roots are different files. A wanted path that is absolute
    names its file whatever the root.
    """
    key = ["root", "path"] if "root" in wanted.columns and "root" in files.columns else ["path"]
    if "absolute" not in files.columns:
        return wanted.join(files.select(*key, "content"), key, "left")
    whole = F.startswith("path", F.lit("/")) | F.col("path").rlike("^[a-z0-9]+://")
    absolute = wanted.where(whole).join(files.select(F.col("absolute").alias("path"), "content"), "path", "left")
    return wanted.where(~whole).join(files.select(*key, "content"), key, "left").unionByName(absolute)


def convert_pdfs(spark: SparkSession, folder: str, done: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """stem, modified, markdown of the *.pdf files directly in `folder` that are newer than their row in `done`.

    done: stem, modified. `convert` runs inside tasks; a file that it fails on has null markdown.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("stem"), F.col("modificationTime").alias("modified"), "content")
    fresh = named.join(done.select("stem", F.col("modified").alias("_done")), "stem", "left").where(F.col("_done").isNull() | (F.col("modified") > F.col("_done"))).drop("_done")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content in batch["content"]:
                try:
                    texts.append(convert(bytes(content)))
                except Exception:
                    texts.append(None)
            yield batch[["stem", "modified"]].assign(markdown=texts)

    return fresh.mapInPandas(each, "stem string, modified timestamp, markdown string").orderBy("stem")
