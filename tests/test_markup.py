"""Elements of XML texts against the standard library's parser, and faults of broken texts."""

import random
import re
import xml.parsers.expat

import pyarrow as pa
import pytest

from veritrail.functions import nesting
from veritrail.operators import markup

ANDROID = "http://schemas.android.com/apk/res/android"


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "path long, raw string")


def plain(text):
    """(node, parent, depth, tag, line, column, attributes, text) of each element of a sound text, by expat."""
    found, stack = [], []
    parser = xml.parsers.expat.ParserCreate()
    parser.buffer_text = True
    parser.ordered_attributes = True

    def start(tag, attributes):
        node = {"node": len(found), "parent": stack[-1]["node"] if stack else None, "depth": len(stack), "tag": tag, "line": parser.CurrentLineNumber, "column": parser.CurrentColumnNumber + 1, "attributes": list(zip(attributes[::2], attributes[1::2])), "text": ""}
        found.append(node)
        stack.append(node)

    def data(text):
        if stack:
            stack[-1]["text"] += text

    parser.StartElementHandler = start
    parser.EndElementHandler = lambda tag: stack.pop()
    parser.CharacterDataHandler = data
    parser.Parse(text, True)
    return [tuple(x.values()) for x in found]


def made(rnd, depth=0):
    tag = rnd.choice(["a", "b-c", "x:y", "a.b", "_d"])
    attributes = "".join(f"{rnd.choice([' ', chr(10), '  '])}{n}{rnd.choice(['=', ' = '])}{rnd.choice(['{q}v{q}', '{q}a > b{q}', '{q}&amp;lt;{q}', '{q}é &#x1F600;&#65;{q}']).format(q=rnd.choice(['' + chr(34), chr(39)]))}" for n in rnd.sample(["p", "q:r", "z.1"], rnd.randint(0, 3)))
    if depth > 4 or rnd.random() < 0.3:
        return f"<{tag}{attributes}{rnd.choice(['', ' '])}/>"
    inner = "".join(rnd.choice([lambda: made(rnd, depth + 1), lambda: "tex\nt é ", lambda: "<!-- <no> \n-->", lambda: "<![CDATA[<raw>]]>", lambda: "&lt;", lambda: "<?pi x?>"])() for _ in range(rnd.randint(0, 4)))
    return f"<{tag}{attributes}>{inner}</{tag}{rnd.choice(['', ' '])}>"


def got(spark, texts):
    rows = markup.elements(table(spark, texts)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.path, r.node)):
        found.setdefault(r.path, []).append((r.node, r.parent, r.depth, r.tag, r.line, r.column, [(a.name, a.value) for a in r.attributes], r.text))
    return found


def test_elements_against_expat(spark):
    rnd = random.Random(4)
    texts = [rnd.choice(["", '<?xml version="1.0"?>\n', "<!-- x -->\n  "]) + f"<root>\n{made(rnd)}{made(rnd)}</root>" + rnd.choice(["", "\n", "<!-- end -->"]) for _ in range(150)]
    texts.append("<r>" + "<d>" * 60 + "</d>" * 60 + "</r>")
    found = got(spark, texts)
    for i, text in enumerate(texts):
        assert found[i] == plain(text), text


def test_namespaces_and_attribute_places(spark):
    text = f'<m xmlns="urn:d"\n  xmlns:android="{ANDROID}"><a android:name="x" name="y"/><b xmlns:android="urn:o">\n<c\n   android:name="z"/></b><q:e q:f="1"/></m>'
    rows = {r.tag: r for r in markup.elements(table(spark, [text])).collect()}
    assert rows["a"].namespace == "urn:d" and rows["q:e"].namespace is None and rows["q:e"].prefix == "q"
    assert [(a.local_name, a.namespace) for a in rows["a"].attributes] == [("name", ANDROID), ("name", None)]
    assert [(a.namespace, a.line, a.column) for a in rows["c"].attributes] == [("urn:o", 4, 4)]
    assert [(a.name, a.line, a.column) for a in rows["m"].attributes] == [("xmlns", 1, 4), ("xmlns:android", 2, 3)]
    frame = markup.elements(table(spark, [text])).where("tag = 'a'")
    assert frame.select(markup.attribute(frame.attributes, "name"), markup.attribute(frame.attributes, "name", ANDROID), markup.attribute(frame.attributes, "no")).first()[:] == ("y", "x", None)
    warned = markup.problems(table(spark, [text])).collect()
    assert [(w.severity, w.message, w.line, w.column) for w in warned] == [("warning", 'Unresolved namespace prefix "q" on attribute "q:f"', 4, 31)]


FAULTS = {
    "": ("No root element found", 1, 1),
    "  \n x": ("No root element found", 2, 2),
    "<!-- a -->": ("No root element found", 1, 11),
    "<a>": ('Unterminated element "<a>" (missing closing tag)', 1, 1),
    "<a>\n <b>\n</a>": ('Mismatched closing tag: expected "</b>" but found "</a>"', 2, 2),
    "<a><b></b>": ('Unterminated element "<a>" (missing closing tag)', 1, 1),
    "<a x=1/>": ("Expected a quoted attribute value", 1, 6),
    "<a x/>": ('Expected "="', 1, 5),
    "<a\n  x='1": ("Unterminated attribute value", 2, 7),
    "<a><!-- b": ('Unterminated construct, expected "-->"', 1, 10),
    "<a><b 1></b></a>": ("Expected a name", 1, 7),
    "<a> < b</a>": ("Unexpected content while looking for a child element or closing tag", 1, 5),
    "<a></1></a>": ("Expected a name", 1, 6),
    "<a><b></b x></a>": ('Expected ">"', 1, 11),
    "</a>": ("Expected a name", 1, 2),
    "<a / >": ('Expected ">"', 1, 4),
    "<ab='1'/>": ("Expected a name", 1, 4),
    "<a><!DOCTYPE x></a>": ("Unexpected content while looking for a child element or closing tag", 1, 4),
}


def test_faults(spark):
    texts = list(FAULTS)
    rows = {r.path: (r.message, r.line, r.column) for r in markup.problems(table(spark, texts)).where("severity = 'error'").collect()}
    assert {texts[i]: rows[i] for i in rows} == FAULTS
    assert markup.elements(table(spark, texts)).count() == 0


def test_warnings_and_odd_texts(spark):
    texts = ["﻿<!DOCTYPE x>\n<a/>", "<a/>\n <b>", None, "<a>" + "t" * 300_000 + "</a>", "<a " + " ".join(f'k{i}="{i}"' for i in range(3000)) + "/>", "<a>\U0001f600<b/></a>"]
    rows = sorted((r.path, r.message, r.line, r.column) for r in markup.problems(table(spark, texts)).collect())
    assert rows == [(0, markup.DOCTYPE, 1, 1), (1, markup.TRAILING, 2, 2), (2, markup.NO_ROOT, 1, 1)]
    found = got(spark, texts)
    assert [len(found.get(i, [])) for i in range(6)] == [1, 1, 0, 1, 1, 2]
    assert found[5][1][5] == 6 and len(found[3][0][7]) == 300_000 and found[4][0][6][2999] == ("k2999", "2999")
    twice = table(spark, ["<a/>"]).union(table(spark, ["<a/>"]))
    assert markup.elements(twice).count() == 2 and markup.elements(twice.limit(0)).count() == 0


def test_tokens_are_not_shuffled(spark):
    """Texts are shuffled whole, before they are cut into tokens."""
    plan = markup.tokens(table(spark, ["<a><b/></a>"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_elements_are_made_within_tasks(spark):
    """Beyond the one shuffle of texts nothing of elements is shuffled, sorted, joined or written; with ``dealt`` not even these."""
    raw = table(spark, [f'<m xmlns="u"><a b="{i}"/></m>' for i in range(4)])
    for dealt, shuffles in ((False, 1), (True, 0)):
        plan = markup.elements(raw, dealt=dealt)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == shuffles and not any(x in plan for x in ("Window", "Join", "Aggregate", "Sort "))


def test_nearest_declarations_and_entities(spark):
    text = '<a xmlns="1&amp;" xmlns:p="2"><p:b xmlns:p="3" p:x="&lt;"><c xmlns="" p:y="4"/><p:d/></p:b><p:e p:z="5"/>&gt;<f q:w="6"/></a>'
    twin = "<p:a/>"  # declarations of one text say nothing of the next
    rows = {r.tag: r for r in markup.elements(table(spark, [text, twin])).collect()}
    assert {tag: r.namespace for tag, r in rows.items()} == {"a": "1&", "p:b": "3", "c": "", "p:d": "3", "p:e": "2", "f": "1&", "p:a": None}
    names = {a.name: (a.prefix, a.namespace, a.value) for r in rows.values() for a in r.attributes if a.prefix}
    assert names == {"p:x": ("p", "3", "<"), "p:y": ("p", "3", "4"), "p:z": ("p", "2", "5"), "q:w": ("q", None, "6")}
    assert rows["a"].text == ">"


def test_texts_worked_on_apart_or_together(monkeypatch):
    """Where the texts of a batch are parted changes nothing; children and brothers are those of the parents."""
    rnd = random.Random(7)
    cut = re.compile(markup._TOKEN)
    texts = [f"<r>{made(rnd)}é\n{made(rnd)}</r>" for _ in range(40)] + ["", "<a>", "<a/>"]
    tokens = [cut.findall(x) + [""] for x in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(range(len(texts))), pa.array(tokens, pa.list_(pa.string()))], ["path", "doc", "tokens"])
    found = {}
    for size in (1, 300, 1 << 20):
        monkeypatch.setattr(nesting, "CHUNK", size)
        found[size] = [[r for b in nesting.rows(iter([batch]), whole) for r in b.to_pylist()] for whole in (False, True)]
    assert found[1] == found[300] == found[1 << 20]
    flat, whole = found[1]
    assert [w["path"] for w in whole] == [*range(40), 42] and sum(len(w["elements"]) for w in whole) == len(flat)
    for w in whole:
        for e in w["elements"]:
            children = [c for c in w["elements"] if c["parent"] == e["node"]]
            assert w["by_parent"][e["child_at"] : e["child_at"] + e["children"]] == [c["node"] for c in children]
            assert [c["nth"] for c in children] == [sum(b["local_name"] == c["local_name"] for b in children[:i]) for i, c in enumerate(children)]
