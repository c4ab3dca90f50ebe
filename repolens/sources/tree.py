"""Source trees and git logs as DataFrames."""

from __future__ import annotations

import os
import subprocess
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repolens.functions import paths
from repolens.functions.parsing.dispatch import is_special, readable
from repolens.functions.parsing import parse

SYMBOL = "struct<name:string,type:string,line:int,end_line:int,signature:string,docstring:string,called_by:array<string>>"
PARSED = (
    "path string, language string, special boolean, line_count int, imports array<string>, exports array<string>, package string, docstring string, "
    f"symbols array<{SYMBOL}>, pending array<struct<caller:string,called:string>>"
)
GIT_WINDOW, GIT_SECONDS = 500, 15


_LISTED = "path string, length long, modified long, folder boolean"
WALKED = 2000  #: folders that a task opens in one round; it hands the others back
MAX_CONTENT, BATCH_BYTES = 2**30, 32 * 2**20  #: larger files are listed without their content


def _children(base: str, folder: str) -> Iterator[tuple[str, int, int, bool]]:
    """(path below ``base``, bytes, microseconds, whether it is a folder). Links to folders aren't followed; a folder that can't be opened is empty."""
    prefix = f"{folder}/" if folder else ""
    if "://" in base:
        where, top = fs.FileSystem.from_uri(base)
        for info in where.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/"), allow_not_found=True)):
            yield prefix + info.base_name, info.size or 0, (info.mtime_ns or 0) // 1000, info.type == fs.FileType.Directory
        return
    try:
        entries = list(os.scandir(os.path.join(base, folder)))
    except OSError:
        return
    for entry in entries:
        try:
            is_folder = entry.is_dir(follow_symlinks=False)
            if is_folder or entry.is_file():
                found = entry.stat()
                yield prefix + entry.name.encode().decode(), found.st_size, found.st_mtime_ns // 1000, is_folder
        except (OSError, UnicodeEncodeError):  # gone meanwhile, or a name that no string can hold
            continue


def _walker(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.int64()), ("folder", pa.bool_())])
        rows: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        todo = deque(f for b in batches for f in b.column(0).to_pylist())
        for _ in range(WALKED):
            if not todo:
                break
            for path, length, modified, folder in _children(base, todo.popleft()):
                if not folder:
                    rows.append((path, length, modified, False))
                elif not paths.pruned(path.rsplit("/", 1)[-1]):
                    todo.append(path)
            if len(rows) >= 50_000:
                yield batch()
                rows.clear()
        rows += [(f, 0, 0, True) for f in todo]
        if rows:
            yield batch()

    return run


def _base(root: str) -> str:
    """A local path, or an address that ``pyarrow.fs`` can open."""
    local = root.removeprefix("file://").removeprefix("file:")
    return root.rstrip("/") if "://" in local else os.path.abspath(local)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified) of the files below ``root`` that the filters accept: no content is read, and excluded folders aren't opened.

    Paths are relative, with the names as they are. Tasks walk the tree in rounds: each opens so many folders and hands the rest back, which
    the next round deals out evenly, so a tree is listed in a few rounds however uneven it is. A path has to mean the same for every machine.
    """
    base, rounds = _base(root), []
    todo = spark.createDataFrame([("",)], "path string")
    while True:
        found = todo.mapInArrow(_walker(base), _LISTED).persist(StorageLevel.MEMORY_AND_DISK)
        rounds.append(found.where("NOT folder").select("path", "length", "modified"))
        left = found.where("folder").select("path")
        if not (n := left.count()):
            break
        todo = left.repartition(min(n, 4 * spark.sparkContext.defaultParallelism))
    return reduce(DataFrame.unionByName, rounds).where(paths.accepted(F.col("path")))


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = fs.FileSystem.from_uri(base) if "://" in base else (None, base)
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        held: list[tuple[str, bytes | None]] = []
        size = 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in held]), pa.array([c for _, c in held], pa.binary())], schema=schema)
        for b in batches:
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                content = None
                if length <= MAX_CONTENT:
                    try:
                        with where.open_input_stream(f"{top}/{path}") if where else open(os.path.join(top, path), "rb") as f:
                            content = f.read()
                    except OSError:
                        content = None
                held.append((path, content))
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield batch()
                    held.clear()
                    size = 0
        if held:
            yield batch()

    return run


def contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content) of listed files (path, length). What can't be read, or is larger than ``MAX_CONTENT``, has no content."""
    return files.select("path", "length").mapInArrow(_reader(_base(root)), "path string, content binary")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the files below ``root`` that the filters accept; only those are opened."""
    found = listing(spark, root)
    return contents(found.repartition(2 * spark.sparkContext.defaultParallelism), root)


def from_tree(spark: SparkSession, tree: dict[str, str], partitions: int = 2) -> DataFrame:
    """(path, content) of a tree in memory."""
    rows = [(p, bytearray(t, "utf-8")) for p, t in tree.items()]
    return spark.createDataFrame(rows, "path string, content binary").repartition(partitions)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("name", pa.string()), ("type", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("docstring", pa.string()), ("called_by", pa.list_(pa.string()))])
    schema = pa.schema([
        ("path", pa.string()), ("language", pa.string()), ("special", pa.bool_()), ("line_count", pa.int32()), ("imports", pa.list_(pa.string())), ("exports", pa.list_(pa.string())),
        ("package", pa.string()), ("docstring", pa.string()), ("symbols", pa.list_(kinds)), ("pending", pa.list_(pa.struct([("caller", pa.string()), ("called", pa.string())]))),
    ])
    for batch in batches:
        rows = []
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = readable(content.as_py() or b"")
            if text is None:
                continue
            p = parse(path, text)
            symbols = [
                {"name": s.name, "type": s.kind, "line": s.line, "end_line": s.end_line, "signature": s.signature, "docstring": s.docstring, "called_by": [f"{path}::{c}" for c in s.called_by]}
                for s in p.symbols.values()
            ]
            rows.append({
                "path": path, "language": p.language, "special": is_special(p.language), "line_count": p.line_count, "imports": p.imports, "exports": p.exports, "package": p.package,
                "docstring": p.docstring, "symbols": symbols, "pending": [{"caller": a, "called": b} for a, b in p.pending],
            })
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parse_files(files: DataFrame) -> DataFrame:
    """One row per readable file with what its parser found. Binary files are left out."""
    return files.select("path", "content").mapInArrow(_parse_batches, PARSED)


def git_log(spark: SparkSession, root: str, window: int = GIT_WINDOW) -> DataFrame:
    """(pos, date, file), newest commit first; empty without a git folder, git, or an answer in time."""
    rows: list[tuple[int, str, str]] = []
    if os.path.isdir(os.path.join(root, ".git")):
        try:
            said = subprocess.run(
                ["git", "-C", root, "log", f"-n{window}", "--name-only", "--pretty=format:%x1f%ai", "--no-merges"], capture_output=True, text=True, timeout=GIT_SECONDS, errors="replace"
            ).stdout
        except (OSError, subprocess.TimeoutExpired):
            said = ""
        for pos, block in enumerate(said.split("\x1f")[1:]):
            head, *names = block.split("\n")
            rows += [(pos, head.split(" ")[0], n.strip()) for n in names if n.strip()]
    return spark.createDataFrame(rows, "pos int, date string, file string")
