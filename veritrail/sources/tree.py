"""Folder trees as a table: every file, files of no bytes too, and what the exclusions drop.

A partition is a folder, so folders are listed and files read in parallel. Only
folder names are walked when the scan is planned, and excluded folders are not
entered. The tree must be mounted where the tasks run. Options: ``path``;
``excluded``, names of folders split by commas; ``noise``, names of files that
don't count; ``skipBytes``, from which a file is only named; ``contentBytes``, up to
which a file is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritrail.operators import inventory

SCHEMA = "path string, kind string, name string, size_bytes long, content binary, warning string"
# Folders that are not entered, and files that systems and editors leave behind.
EXCLUDED_FOLDERS = ["node_modules", ".git", "dist", "build", "coverage", "reports", "lab-output", "__pycache__", ".idea", ".vscode", ".vitest"]
NOISE_FILES, NOISE_ENDS = [".DS_Store", "Thumbs.db", "desktop.ini"], (".swp", "~")


class Folder(InputPartition):
    def __init__(self, path: str, excluded: tuple[str, ...]) -> None:
        self.path, self.excluded = path, excluded


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"].removeprefix("file:").rstrip("/") or "/"
        self.excluded = set(filter(None, options.get("excluded", "").split(",")))
        self.noise = set(filter(None, options.get("noise", ",".join(NOISE_FILES)).split(",")))
        self.skip, self.read_up_to = int(options.get("skipBytes", inventory.SKIP_BYTES)), int(options.get("contentBytes", inventory.COUNT_LINES_BYTES))

    def partitions(self) -> list[Folder]:
        found, open_ = [], [self.root]
        while open_:
            folder = open_.pop()
            inner = []
            try:
                with os.scandir(folder) as entries:
                    inner = sorted(e.name for e in entries if e.is_dir(follow_symlinks=False))
            except OSError:
                pass  # the folder's own task names the fault
            found.append(Folder(folder, tuple(n for n in inner if n in self.excluded)))
            open_ += [os.path.join(folder, n) for n in inner if n not in self.excluded]
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        below = os.path.relpath(partition.path, self.root)
        inside = lambda name: name if below == "." else f"{below}/{name}".replace(os.sep, "/")
        for name in partition.excluded:
            yield inside(name), "excluded", name, None, None, None
        try:
            entries = sorted(os.scandir(partition.path), key=lambda e: e.name)
        except OSError as e:
            yield inside(""), "unreadable", os.path.basename(partition.path), None, None, str(e)
            return
        for entry in entries:
            if not entry.is_file(follow_symlinks=False) or entry.name in self.noise or entry.name.endswith(NOISE_ENDS):
                continue
            try:
                size = entry.stat(follow_symlinks=False).st_size
                content = None
                if size <= self.read_up_to and size < self.skip:
                    with open(entry.path, "rb") as f:
                        content = f.read()
            except OSError as e:
                yield inside(entry.name), "unreadable", entry.name, None, None, str(e)
                continue
            yield inside(entry.name), "file" if size < self.skip else "oversized", entry.name, size, content, None


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, excluded: list[str] | None = None, **options: object) -> DataFrame:
    """path (below ``root``), kind (file, oversized, unreadable, excluded), name, size_bytes, content, warning."""
    spark.dataSource.register(Tree)
    reader = spark.read.format("tree").option("path", root).option("excluded", ",".join(EXCLUDED_FOLDERS if excluded is None else excluded))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def files(tree: DataFrame) -> DataFrame:
    """path, size_bytes, content of the files that count, as ``inventory`` takes them."""
    return tree.where("kind = 'file'").select("path", "size_bytes", "content")


def excluded_folders(tree: DataFrame) -> DataFrame:
    """name, occurrences of excluded folders."""
    return tree.where("kind = 'excluded'").groupBy("name").agg(F.count(F.lit(1)).alias("occurrences"))


def summary(tree: DataFrame) -> DataFrame:
    """One row: total_files, scanned_files, skipped_files, oversized_files, empty_files, unreadable_folders."""
    is_file = F.col("kind").isin("file", "oversized") | ((F.col("kind") == "unreadable") & ~F.col("path").endswith("/"))
    kind = lambda k: F.count_if(F.col("kind") == k)
    return tree.agg(F.count_if(is_file).alias("total_files"), kind("file").alias("scanned_files"), F.count_if(is_file & (F.col("kind") != "file")).alias("skipped_files"), kind("oversized").alias("oversized_files"), F.count_if((F.col("kind") == "file") & (F.col("size_bytes") == 0)).alias("empty_files"), F.count_if((F.col("kind") == "unreadable") & F.col("path").endswith("/")).alias("unreadable_folders"))


# What a scan for secrets reads, by patterns of paths.
SCANNED = [r"package\.json", r"package-lock\.json", r"npm-shrinkwrap\.json", r"tsconfig\.json", r"tsconfig\.[^/]*\.json", r"\.env", r"\.env\.[^/]*", "src/.*", "scripts/.*"]


def bounded_sources(tree: DataFrame, patterns: list[str] | None = None, left_out: list[str] | None = None, most_bytes: int = 1_000_000) -> DataFrame:
    """path, text of the files that a scan reads: paths of some patterns, at most ``most_bytes``, no zero byte in them. Read the tree with ``contentBytes`` of as many."""
    scanned = "^(?:" + "|".join(patterns or SCANNED) + ")$"
    rows = tree.where((F.col("kind") == "file") & F.col("path").rlike(scanned) & ~F.col("path").isin(left_out or []) & (F.col("size_bytes") <= most_bytes) & F.col("content").isNotNull())
    return rows.where(~F.hex("content").rlike("^(?:..)*?00")).select("path", F.decode("content", "UTF-8").alias("text"))
