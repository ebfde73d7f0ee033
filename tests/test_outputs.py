"""Answers, usage, source facts, sinks and the streaming extension."""

import json

from veritrail.operators import answers, facts
from veritrail.sources import reports
from veritrail.streaming import events


def test_answers(spark):
    texts = ['{"answer": "a", "relevantFiles": ["x.ts"]}', 'Sure:\n```json\n{"answer": "b", "relevantSymbols": ["S"]}\n```', "Answer: c\nFiles: `a.ts`, b.ts\n", "## Files\n- a.ts\n- b.ts\n\n## Answer\nd\n", "", "nothing here", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id int, final_answer string")
    got = {r.run_id: (r.parse_status, r.answer_text, r.relevant_files, r.relevant_symbols) for r in answers.parse_answers(df).collect()}
    assert got[0] == ("parsed", "a", ["x.ts"], []) and got[1] == ("parsed", "b", [], ["S"])
    assert got[2] == ("partial", "c", ["a.ts", "b.ts"], []) and got[3][:3] == ("partial", "d", ["a.ts", "b.ts"])
    assert got[4][0] == got[5][0] == got[6][0] == "failed"


def test_usage(spark):
    texts = ['{"usage": {"input_tokens": 5, "output_tokens": 7}} {"input_tokens": 9}', '{"promptTokens": 3}', "Total tokens: 1,234", "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id int, output string")
    got = {r.run_id: (r.input_tokens, r.output_tokens, r.total_tokens, r.reliability) for r in answers.token_usage(df).collect()}
    assert got == {0: (9, 7, 16, "high"), 1: (3, None, 3, "medium"), 2: (None, None, 1234, "low"), 3: (None, None, None, None), 4: (None, None, None, None)}


def test_source_facts(spark):
    rows = [("a.py", "python", "source", 9, "from x.y import z\nimport os\ndef f():\n  pass\nclass _C:"), ("a.ts", "typescript", "test", 9, "import {a} from './b'\nexport const q = 1\nfunction h() {}"), ("a.go", "unknown", "source", 9, "x"), ("big.py", "python", "source", 9_000_000, "x"), ("d.md", "markdown", "docs", 1, "x")]
    got = {r.path: r for r in facts.source_facts(spark.createDataFrame(rows, "path string, language string, role string, size_bytes long, content string")).collect()}
    assert set(got) == {"a.py", "a.ts", "a.go", "big.py"}
    assert [(i.source, i.line) for i in got["a.py"].imports] == [("x.y", 1), ("os", 2)]
    assert [(d.name, d.exported) for d in got["a.py"].declarations] == [("f", True), ("_C", False)]
    assert [(d.name, d.exported) for d in got["a.ts"].declarations] == [("q", True), ("h", False)] and got["a.ts"].imports[0].source == "./b"
    assert (got["a.go"].parse_status, got["big.py"].parse_status) == ("unsupported", "file-level-only")


def test_sinks(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "concat('<', id, '>') AS name")
    reports.write_table(df, str(tmp_path / "t"), by=["id"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    reports.write_document(df, str(tmp_path / "d"), "T", most=2)
    (part,) = (tmp_path / "d").glob("part-*.json")
    doc = json.loads(part.read_text())
    assert (doc["total"], doc["displayed"], doc["omitted"], len(doc["rows"])) == (5, 2, 3, 2)
    page = reports.html_table(df, "A & B", most=1)
    assert "A &amp; B" in page and "&lt;0&gt;" in page and "1 of 5 rows" in page
    assert tuple(reports.padded_domain(df, "id").first()) == (-0.4, 4.4) and tuple(reports.padded_domain(df.limit(1), "id").first()) == (-1.0, 1.0)


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    path = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(path)
    events.run_once(events.windowed_counts(events.event_stream(spark, path)), "event_windows", str(tmp_path / "c"))
    key = lambda df: sorted((str(r.window_start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("event_windows")) == key(events.windowed_counts(spark.read.parquet(path)))
