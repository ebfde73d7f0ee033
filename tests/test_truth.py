"""Folder trees, what projects say of themselves, summaries of candidates, and small text helpers."""

import json

from pyspark.sql import functions as F

from veritrail.functions import text as X
from veritrail.operators import security, truth
from veritrail.sources import tree as T


def test_tree(spark, tmp_path):
    for folder in ("src/deep", "node_modules/a", "src/node_modules", "empty", "dist"):
        (tmp_path / folder).mkdir(parents=True)
    made = {"a.txt": b"one\ntwo", "none.txt": b"", ".DS_Store": b"x", "a.txt~": b"x", "x.swp": b"", "src/b c.ts": b"x" * 30, "src/deep/big.ts": b"y" * 50, "src/deep/bin.ts": b"a\0b", "node_modules/a/no.js": b"n", "package.json": b"{}"}
    for name, data in made.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    tree = T.read_tree(spark, str(tmp_path), skipBytes=50, contentBytes=20)
    rows = {(r.kind, r.path): (r.size_bytes, None if r.content is None else bytes(r.content)) for r in tree.collect()}
    assert rows == {("file", "a.txt"): (7, b"one\ntwo"), ("file", "none.txt"): (0, b""), ("file", "src/b c.ts"): (30, None), ("oversized", "src/deep/big.ts"): (50, None), ("file", "src/deep/bin.ts"): (3, b"a\0b"), ("file", "package.json"): (2, b"{}"), ("excluded", "node_modules"): (None, None), ("excluded", "src/node_modules"): (None, None), ("excluded", "dist"): (None, None)}
    assert {r.name: r.occurrences for r in T.excluded_folders(tree).collect()} == {"node_modules": 2, "dist": 1}
    assert T.summary(tree).first().asDict() == {"total_files": 6, "scanned_files": 5, "skipped_files": 1, "oversized_files": 1, "empty_files": 1, "unreadable_folders": 0}
    assert T.files(tree).count() == 5 and tree.rdd.getNumPartitions() == 4
    whole = T.read_tree(spark, str(tmp_path), contentBytes=1_000_000)
    assert sorted(r.path for r in T.bounded_sources(whole).collect()) == ["package.json", "src/b c.ts", "src/deep/big.ts"]
    assert [r.path for r in T.bounded_sources(whole, left_out=["src/b c.ts"], most_bytes=40).collect()] == ["package.json"]
    gone = T.read_tree(spark, str(tmp_path / "gone"))
    assert [(r.kind, r.path) for r in gone.collect()] == [("unreadable", "")] or T.summary(gone).first().total_files == 0
    assert T.read_tree(spark, str(tmp_path), excluded=[]).where("kind = 'excluded'").count() == 0


def test_packages_and_lockfiles(spark):
    package = {"name": "p", "version": "1.0.0", "description": 5, "bin": "cli.js", "typings": "t.d.ts", "scripts": {"test": "x", "security:deps": "y", "Build-all": "z", "prepack": "w", "odd": "v"}, "dependencies": {"a": 1}, "engines": {"node": ">=20"}, "files": ["a", 2, "b"]}
    raw = spark.createDataFrame([("a", json.dumps(package)), ("b", "{}"), ("c", "nope"), ("d", None), ("e", '{"name": "e"}')], "root string, raw string")
    found = truth.packages(raw)
    rows = {r.root: r for r in found.collect()}
    assert set(rows) == {"a", "b", "e"}
    a = rows["a"]
    assert (a.name, a.version, a.description, a.types, a.bin, a.dependencies, a.engines, a.files, a.peer_dependencies) == ("p", "1.0.0", None, "t.d.ts", {"": "cli.js"}, {}, {"node": ">=20"}, ["a", "b"], None)
    assert (rows["b"].scripts, rows["b"].name, rows["b"].files) == ({}, None, None)
    assert {r.name: r.script_group for r in truth.commands(found).collect()} == {"test": "test", "security:deps": "security", "Build-all": "build", "prepack": "release", "odd": "other"}
    locks = spark.createDataFrame([("a", '{"lockfileVersion": 3, "packages": {"": {"name": "p", "version": "1.0.1"}}}'), ("b", '{"name": "x", "lockfileVersion": "3"}'), ("e", "broken")], "root string, raw string")
    got = {r.root: (r.present, r.name, r.version, r.lockfile_version, r.consistent) for r in truth.lockfiles(locks, found).collect()}
    assert got == {"a": (True, "p", "1.0.1", 3.0, False), "b": (True, "x", None, None, None), "e": (False, None, None, None, None)}


def test_documents(spark):
    docs = spark.createDataFrame([("docs/README.md", "intro\n# The  title\n# Other\nWe audit. npm publish."), ("CHANGELOG.md", "security validation is planned, Experimental"), ("big.md", "# T\naudit " + "x" * 200_000), ("n.md", None)], "path string, content string")
    got = {r.path: r.asDict() for r in truth.documents(docs).collect()}
    assert got["docs/README.md"]["title"] == "The  title" and got["docs/README.md"]["is_readme"] and got["docs/README.md"]["mentions_audit"] and got["docs/README.md"]["mentions_release_publish"]
    assert got["CHANGELOG.md"]["is_changelog"] and got["CHANGELOG.md"]["mentions_security_validation"] and got["CHANGELOG.md"]["mentions_planned_commands"] and got["CHANGELOG.md"]["mentions_experiments"] and got["CHANGELOG.md"]["title"] is None
    assert got["big.md"]["title"] is None and not got["big.md"]["mentions_audit"] and got["n.md"]["title"] is None


def test_candidate_roll_up(spark):
    rows = [("c1", "high", "resolved", "b"), ("c1", "low", "missing", "a"), ("c2", "high", "resolved", "a")]
    got = {(r.dimension, r.value): r.n for r in security.candidate_roll_up(spark.createDataFrame(rows, "check_id string, confidence string, resolution_state string, category string")).collect()}
    states = {("resolution_state", s): 0 for s in security.RESOLUTION_STATES}
    assert got == states | {("total", None): 3, ("checks_with_candidates", None): 2, ("confidence", "high"): 2, ("confidence", "unknown"): 0, ("confidence", "medium"): 0, ("confidence", "low"): 1, ("resolution_state", "resolved"): 2, ("resolution_state", "missing"): 1, ("category", "a"): 2, ("category", "b"): 1}
    none = spark.createDataFrame([], "check_id string, confidence string, resolution_state string, category string")
    assert {r.n for r in security.candidate_roll_up(none).collect()} == {0}


def test_labels_and_durations(spark):
    row = spark.createDataFrame([('a\\b "c"\n\r<d>{e}|f', "2024-01-01 00:00:00.250", "2024-01-01 00:00:02")], "t string, s string, e string").select(X.escape_dot_label(F.col("t")), X.duration_ms(F.col("s").cast("timestamp"), F.col("e").cast("timestamp")), X.duration_ms(F.col("e").cast("timestamp"), F.col("s").cast("timestamp"))).first()
    assert row[:] == ('a\\\\b \\"c\\"\\n\\r\\<d\\>\\{e\\}\\|f', 1750, -1750)


def test_order_of_dictionaries(spark):
    words = ["b", "A", "a", "é", "e", "_x", "Z", "z-1", "z1", "E", "ß", "ss"]
    got = spark.createDataFrame([(words + ["a"],)], "w array<string>").select(X.locale_sorted(F.col("w"))).first()[0]
    assert got == ["_x", "a", "A", "b", "e", "E", "é", "ss", "ß", "Z", "z-1", "z1"]
    rows = spark.createDataFrame([(c, "r", None, "p", i, None, "f") for i, c in enumerate(["b", "A", "é", "a", "e"])], "category string, rule_id string, module_path string, path string, line int, col int, fingerprint string")
    assert [r.category for r in rows.orderBy(*security.candidate_order()).collect()] == ["a", "A", "b", "e", "é"]
