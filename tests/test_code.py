"""Code without comments and strings, and facts of sources whose statements go over several lines."""

from pyspark.sql import functions as F

from veritrail.functions.code import PIECES, code_only
from veritrail.operators import facts


def test_code_only(spark):
    cases = [
        ("typescript", "a = 'x // y' // 'z\nb /* \" \n*/ c", "a = '______' //   \nb      \n   c".replace("//", "  ")),
        ("typescript", "`t ${'a'} \n//` + \"q\\\"/*\" / 2 /* end", "`________ \n__` + \"_____\" / 2       ".replace("________ ", "_________")),
        ("javascript", "x.replace(/[\"'/]/g, 'b'); a / b / c // d", "x.replace(/______g, '_'); a / b / c     "),
        ("python", "a = '''x # \"\n''' # '\nb = \"#\"", "a = '_______\n__'    \nb = \"_\""),
        ("java", 'String s = """\n// no "q"\n"""; // yes', 'String s = "__\n_________\n__";       '),
        ("kotlin", "val c = '\"' /* \n", "val c = '_'    \n"),
    ]
    for language, text, want in cases:
        got = spark.createDataFrame([(text,)], "t string").select(code_only(F.col("t"), language)).first()[0]
        assert got == want, (language, got)
    for language in PIECES:
        rows = spark.createDataFrame([("",), (None,), ("'" * 50_001,), ("\\" * 1001,), ("/" * 1001,), ('"' + "x" * 300_000,)], "t string")
        assert all(r.t is None or len(r.c) == len(r.t) for r in rows.withColumn("c", code_only(F.col("t"), language)).collect())


TS = """// import { no } from './comment'
import a, {
  b, // c,
  type C,
  d as e,
} from "./one";
import * as ns from './two'; import './three';
const s = "import x from './string'"; /* export const hidden = 1
*/ export * from './four';
export { f } from
  "./five";
const g = require( './six' ), h = await import('./seven');
obj.require('./no'); const t = `
export function inTemplate() {}
`;
export const real = 1;
import type T from "./eight";
"""
PY = '"""\nimport no\n"""\nfrom a.b import (\n    c,  # d\n    e as f,\n)\nimport g.h, i\n# import j\ndef k(): pass\n'
JAVA = "/* import no.No; */\nimport a.b.C;\nimport static d.E.f;\nimport g.*;\n// public class Hidden\npublic class Shown {}\n"


def test_facts_over_several_lines(spark):
    rows = [("a.ts", "typescript", TS), ("b.py", "python", PY), ("c.java", "java", JAVA), ("d.ts", "typescript", None), ("e.ts", "typescript", "x" * 1_000_001), ("f.rb", "ruby", "")]
    table = spark.createDataFrame([(p, language, "source", 1, t) for p, language, t in rows], "path string, language string, role string, size_bytes long, content string")
    got = {r.path: r for r in facts.source_facts(table).collect()}
    assert [(i.source, i.importedNames, i.line) for i in got["a.ts"].imports] == [("./one", ["a", "b", "C", "e"], 2), ("./two", ["ns"], 7), ("./three", [], 7), ("./four", [], 9), ("./five", [], 10), ("./six", [], 12), ("./seven", [], 12), ("./eight", ["T"], 17)]
    assert [(d.name, d.exported, d.line) for d in got["a.ts"].declarations if d.exported] == [("real", True, 16)]
    assert [(i.source, i.importedNames, i.line) for i in got["b.py"].imports] == [("a.b", ["c", "f"], 4), ("g.h", ["h", "i"], 8)]
    assert [(i.source, i.importedNames, i.line) for i in got["c.java"].imports] == [("a.b.C", ["C"], 2), ("d.E.f", ["f"], 3), ("g.", [""], 4)]
    assert [d.name for d in got["c.java"].declarations] == ["Shown"]
    assert {p: r.parse_status for p, r in got.items()} == {"a.ts": "parsed", "b.py": "parsed", "c.java": "parsed", "d.ts": "file-level-only", "e.ts": "file-level-only", "f.rb": "unsupported"}
