"""Elements of XML texts with their places, parents and namespaces, and faults of texts.

A text is cut into tokens that follow each other without gaps (tags, comments,
sections, texts), so a token's place is the sum of the lengths before it. Tags
nest by a running sum: an opener is one level below the sum before it, and its
parent is the last opener of the level above. Elements are made by array
operations over the tokens of many texts (``functions.nesting``), faults by
windows over the tokens of each. Texts are shuffled once at most, by number,
before they are cut; nothing else is shuffled or written.

Columns and lines count from 1, columns in UTF-16 units; a first byte order mark
is left out. A text is sound if it has one root element whose tags match and
whose attributes are quoted; what follows the root only gives a warning. Of a
text that isn't sound there are no elements, but a row of ``problems`` with the
first fault. Entities are replaced in values and texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veritrail.functions import nesting
from veritrail.functions.stored import spread

_WS = r"[ \t\n\r]"
_NAME = r"[A-Za-z_:][A-Za-z0-9_.:-]*+"
_ATTRIBUTE = rf"""{_NAME}{_WS}*+={_WS}*+(?:"[^"]*+"|'[^']*+')"""
# Repetitions are possessive, so matching takes no stack and time in the length of the text.
_OPENER = rf"<{_NAME}(?:{_WS}*+{_ATTRIBUTE})*+{_WS}*+/?>"
_TOKEN = rf"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!(?:DOCTYPE|doctype)[^>]*+>|</{_NAME}{_WS}*+>|{_OPENER}|[^<]++|<"

# The messages of faults and warnings.
NO_ROOT = "No root element found"
UNEXPECTED = "Unexpected content while looking for a child element or closing tag"
TRAILING = "Unexpected trailing content after the root element was ignored"
DOCTYPE = "DOCTYPE declaration encountered and skipped (not evaluated)"


def _units(x: Column) -> Column:
    """Length in UTF-16 units, where a character beyond the basic plane counts as two."""
    return F.length(x) + F.length(x) - F.length(F.regexp_replace(x, r"[\x{10000}-\x{10FFFF}]", ""))


def _breaks(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n")))


def _after_break(x: Column) -> Column:
    """Units after the last line break."""
    return _units(F.substring_index(x, "\n", -1))


def decoded(x: Column) -> Column:
    """Entities replaced: named ones, numbers in either base, and ``&amp;`` last."""
    named = x
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&apos;", "'"), ("&quot;", '"')):
        named = F.replace(named, F.lit(entity), F.lit(character))
    for pattern, base in (("&#([0-9]+);", 10), ("&#x([0-9a-fA-F]+);", 16)):
        named = _with_characters(named, pattern, base)
    return F.replace(named, F.lit("&amp;"), F.lit("&"))


def _with_characters(x: Column, pattern: str, base: int) -> Column:
    codes = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    # chr is modulo 256, so characters are made from their UTF-32 bytes.
    characters = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(F.conv(c, base, 16), 8, "0")), "UTF-32"))
    between = F.arrays_zip(F.split(x, pattern).alias("p"), characters.alias("c"))
    joined = F.array_join(F.flatten(F.transform(between, lambda z: F.array(z["p"], F.coalesce(z["c"], F.lit(""))))), "")
    return F.when(F.size(codes) > 0, joined).otherwise(x)


def _kind(t: Column) -> Column:
    return (
        F.when(~t.startswith("<"), "text")
        .when(F.length(t) == 1, "bad")
        .when(t.startswith("<!--") | t.startswith("<?"), "skip")
        .when(t.startswith("<![CDATA["), "section")
        .when(t.startswith("<!"), "doctype")
        .when(t.startswith("</"), "close")
        .when(t.endswith("/>"), "single")
        .otherwise("open")
    )


def _cut(raw: DataFrame, dealt: bool = False) -> DataFrame:
    """path, doc and tokens of texts (path, raw), which are dealt out to tasks unless they are so already."""
    text = F.regexp_replace("raw", r"^\x{FEFF}", "")
    docs = raw.select("path", F.monotonically_increasing_id().alias("doc"), F.coalesce(text, F.lit("")).alias("raw"))
    # An empty last token stands for the end, where faults can lie as well.
    return (docs if dealt else spread(docs, "doc")).select("path", "doc", F.concat(F.regexp_extract_all("raw", F.lit(_TOKEN), F.lit(0)), F.array(F.lit(""))).alias("tokens"))


def tokens(raw: DataFrame) -> DataFrame:
    """Every token of texts (path, raw): doc, path, i, token, kind, line, column, at (units before it), level, node (elements before it), over (the root has ended)."""
    cut = _cut(raw).select("path", "doc", F.posexplode("tokens").alias("i", "token"))
    before = Window.partitionBy("doc").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.when(F.col("token") == "", "end").otherwise(_kind(F.col("token")))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    placed = cut.withColumn("kind", kind).withColumns({"at": F.coalesce(F.sum(_units(F.col("token"))).over(before), F.lit(0)), "line": F.coalesce(F.sum(_breaks(F.col("token"))).over(before), F.lit(0)) + 1, "_sum": F.coalesce(F.sum(step).over(before), F.lit(0)).cast("int"), "node": F.coalesce(F.count_if(F.col("kind").isin("open", "single")).over(before), F.lit(0))})
    line_at = F.when(F.contains("token", F.lit("\n")), F.col("at") + _units(F.col("token")) - _after_break(F.col("token")))
    ends = ((F.col("kind") == "close") & (F.col("_sum") <= 1)) | ((F.col("kind") == "single") & (F.col("_sum") == 0))
    over = F.coalesce(F.max(ends).over(before), F.lit(False))
    column = F.col("at") - F.coalesce(F.last(line_at, ignorenulls=True).over(before), F.lit(0)) + 1
    return placed.withColumns({"column": column, "over": over}).withColumn("level", F.col("_sum") - F.when(F.col("kind") == "close", 1).otherwise(0)).drop("_sum")


def _nested(raw: DataFrame) -> DataFrame:
    """``tokens`` with opener: for elements the last opener of the level above, for closing tags of their own level, for texts of the level they lie in."""
    rows = tokens(raw)
    opens = F.struct(F.col("level").alias("group"), F.lit(True).alias("gives"))
    asks = F.struct(F.when(F.col("kind") == "close", F.col("level")).otherwise(F.col("level") - 1).alias("group"), F.lit(False).alias("gives"))
    dealt = rows.withColumn("_g", F.explode(F.when(F.col("kind") == "open", F.array(opens, asks)).otherwise(F.array(asks)))).select("*", "_g.*").drop("_g")
    given = F.when(F.col("gives"), F.struct("i", "node", _name(F.col("token")).alias("name"), "line", "column"))
    own = Window.partitionBy("doc", "group").orderBy("i", "gives").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.withColumn("opener", F.last(given, ignorenulls=True).over(own)).where("NOT gives").drop("group", "gives").withColumn("element", F.col("kind").isin("open", "single"))


def _name(token: Column) -> Column:
    return F.regexp_extract(token, rf"^</?({_NAME})", 1)


def _tag_fault(rest: Column) -> tuple[Column, Column]:
    """What is read of a broken tag before its fault, and the message."""
    read = F.regexp_extract(rest, rf"^<{_NAME}(?:{_WS}*+{_ATTRIBUTE})*+{_WS}*+", 0)
    left = F.substr(rest, F.length(read) + 1)
    named = F.regexp_extract(left, rf"^{_NAME}{_WS}*+", 0)
    value = F.regexp_extract(left, rf"^{_NAME}{_WS}*+={_WS}*+", 0)
    message = (
        F.when(left.rlike("^(/|$)"), 'Expected ">"')
        .when(named == "", "Expected a name")
        .when(value == "", 'Expected "="')
        .when(~F.substr(left, F.length(value) + 1).rlike("^[\"']"), "Expected a quoted attribute value")
        .otherwise("Unterminated attribute value")
    )
    consumed = F.when(left.rlike("^(/|$)") | (named == ""), read).when(value == "", F.concat(read, named)).when(message == "Unterminated attribute value", rest).otherwise(F.concat(read, value))
    return consumed, message


def _fault(rest: Column, inside: Column) -> tuple[Column, Column]:
    """What is read of a text that begins with a fault, and the message."""
    consumed, message = _tag_fault(rest)
    tag = rest.rlike("^<[A-Za-z_:]")
    ends = [("<!--", "-->"), ("<![CDATA[", "]]>"), ("<?", "?>")]
    open_, unended = F.lit(None).cast("string"), F.lit(None).cast("string")
    for start, end in ends:
        open_ = F.when(rest.startswith(start), rest).otherwise(open_)
        unended = F.when(rest.startswith(start), f'Unterminated construct, expected "{end}"').otherwise(unended)
    doctype = ~inside & rest.rlike("^<!(DOCTYPE|doctype)")
    closing = inside & rest.startswith("</")
    closed = F.regexp_extract(rest, rf"^</({_NAME}{_WS}*+)?", 0)
    return (
        F.when(tag, consumed).when(open_.isNotNull(), open_).when(doctype, rest).when(closing, closed).when(~inside, F.lit("<")).otherwise(F.lit("")),
        F.when(tag, message)
        .when(open_.isNotNull(), unended)
        .when(doctype, 'Unterminated construct, expected ">"')
        .when(closing, F.when(closed == "</", "Expected a name").otherwise('Expected ">"'))
        .when(~inside, "Expected a name")
        .otherwise(UNEXPECTED),
    )


def _inside(kind: Column) -> Column:
    return F.col("level") + F.when(kind == "close", 1).otherwise(0) > 0


def _wrong() -> Column:
    """What is wrong with a token of ``_nested``, if anything is."""
    kind, over = F.col("kind"), F.col("over")
    inside = _inside(kind)
    blank = kind.isin("skip", "doctype", "section") | ((kind == "text") & ~F.col("token").rlike(r"[^ \t\n\r]"))
    stray = ~inside & ((kind == "text") & ~blank | (kind == "end"))
    broken = (kind == "bad") | ((kind == "doctype") & inside) | ((kind == "close") & ~inside)
    mismatch = inside & (kind == "close") & (_name(F.col("token")) != F.col("opener.name"))
    return F.when(~over, F.when(stray, "stray").when(broken, "broken").when(mismatch, "mismatch").when(inside & (kind == "end"), "unended"))


def _faults(nested: DataFrame) -> DataFrame:
    """doc, path, i, message, line, column of the first fault of each text that has one."""
    first_text = F.regexp_extract("token", rf"^{_WS}*+", 0)
    what, inside = _wrong(), _inside(F.col("kind"))
    found = nested.where(what.isNotNull()).select("doc", "path", F.struct("i", what.alias("what"), "token", "at", "line", "column", "opener", inside.alias("inside"), first_text.alias("blank")).alias("x"))
    first = found.groupBy("doc", "path").agg(F.min_by("x", "x.i").alias("x")).select("doc", "path", "x.*")
    # A broken token is read with what follows it; of each text one is, so its rest is made once.
    rest = nested.join(first.where("what = 'broken'").select("doc", F.col("i").alias("_from")), "doc").where("i >= _from").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda t: t["token"]), "").alias("rest"))
    joined = first.join(rest, "doc", "left")
    consumed, message = _fault(F.col("rest"), F.col("inside"))
    read = F.when(F.col("what") == "broken", consumed).when(F.col("what") == "stray", F.when(F.col("token") == "", "").otherwise(F.col("blank")))
    text = (
        F.when(F.col("what") == "stray", NO_ROOT)
        .when(F.col("what") == "broken", message)
        .when(F.col("what") == "mismatch", F.concat(F.lit('Mismatched closing tag: expected "</'), "opener.name", F.lit('>" but found "</'), _name(F.col("token")), F.lit('>"')))
        .otherwise(F.concat(F.lit('Unterminated element "<'), "opener.name", F.lit('>" (missing closing tag)')))
    )
    at_opener = F.col("what").isin("mismatch", "unended")
    line = F.when(at_opener, F.col("opener.line")).otherwise(F.col("line") + _breaks(read))
    column = F.when(at_opener, F.col("opener.column")).when(_breaks(read) > 0, _after_break(read) + 1).otherwise(F.col("column") + _units(read))
    return joined.select("doc", "path", "i", text.alias("message"), line.alias("line"), column.alias("column"))


_ATTRIBUTES = "array<struct<name:string,prefix:string,local_name:string,namespace:string,value:string,line:bigint,column:bigint>>"
_CELLS = f"node bigint, parent bigint, depth int, tag string, prefix string, local_name string, namespace string, line bigint, column bigint, attributes {_ATTRIBUTES}, text string, coded boolean"


def plain(x: Column) -> Column:
    """``decoded``, at no cost where there is nothing to replace."""
    return F.when(F.contains(x, F.lit("&")), decoded(x)).otherwise(x)


def elements(raw: DataFrame, dealt: bool = False) -> DataFrame:
    """One row per element of sound texts (path, raw).

    path, doc, node (from 0, in order), parent (null for the root), depth, tag,
    prefix, local_name, namespace, line, column, attributes (name, prefix,
    local_name, namespace, value, line, column) and text (its own, without that
    of elements within it). ``doc`` tells rows with the same path apart. With
    ``dealt`` the rows of ``raw`` stay in their tasks.
    """
    rows = _made(raw, False, _CELLS, dealt)
    attributes = F.transform("attributes", lambda a: a.withField("namespace", plain(a["namespace"])).withField("value", plain(a["value"])))
    return rows.withColumns({"namespace": plain(F.col("namespace")), "attributes": F.when(F.col("coded"), attributes).otherwise(F.col("attributes")), "text": plain(F.col("text"))}).drop("coded")


def trees(raw: DataFrame, dealt: bool = False) -> DataFrame:
    """path, doc, elements and by_parent of sound texts (path, raw), a row each.

    elements: those of ``elements`` by node, with entities as they stand (see
    ``plain``), coded (the tag has any), nth (how many brothers of the same local name come before),
    child_at and children. by_parent: the nodes of all children, where those of
    an element are ``children`` ones from ``child_at`` on.
    """
    each = StructType.fromDDL(f"{_CELLS}, nth int, child_at int, children int").simpleString()
    return _made(raw, True, f"elements array<{each}>, by_parent array<int>", dealt)


def _made(raw: DataFrame, whole: bool, cells: str, dealt: bool) -> DataFrame:
    cut = _cut(raw, dealt)
    schema = StructType([*cut.schema.fields[:2], *StructType.fromDDL(cells).fields])
    return cut.mapInArrow(lambda batches: nesting.rows(batches, whole), schema)


def problems(raw: DataFrame) -> DataFrame:
    """path, severity (``error`` for the first fault, else ``warning``), message, line, column of texts (path, raw)."""
    nested = _nested(raw)
    faults = _faults(nested)
    errors = faults.select("path", F.lit("error").alias("severity"), "message", "line", "column")
    early = nested.join(faults.select("doc", F.col("i").alias("_stop")), "doc", "left").where("_stop IS NULL OR i < _stop")
    doctype = early.where("kind = 'doctype'").select("path", F.lit("warning").alias("severity"), F.lit(DOCTYPE).alias("message"), "line", "column")
    after = early.where(F.col("over") & ~F.col("kind").isin("skip", "doctype", "section", "end") & F.col("token").rlike(r"[^ \t\n\r]"))
    first = after.groupBy("doc", "path").agg(F.min_by(F.struct("token", "line", "column"), "i").alias("x")).select("path", "x.*")
    blank = F.regexp_extract("token", rf"^{_WS}*+", 0)
    trailing = first.select("path", F.lit("warning").alias("severity"), F.lit(TRAILING).alias("message"), (F.col("line") + _breaks(blank)).alias("line"), F.when(_breaks(blank) > 0, _after_break(blank) + 1).otherwise(F.col("column") + _units(blank)).alias("column"))
    attributes = elements(raw).select("path", F.explode("attributes").alias("a")).where("a.prefix IS NOT NULL AND a.namespace IS NULL")
    unresolved = attributes.select("path", F.lit("warning").alias("severity"), F.concat(F.lit('Unresolved namespace prefix "'), "a.prefix", F.lit('" on attribute "'), "a.name", F.lit('"')).alias("message"), F.col("a.line").alias("line"), F.col("a.column").alias("column"))
    return errors.unionByName(doctype).unionByName(trailing).unionByName(unresolved)


def attribute(attributes: Column, local_name: str, namespace: str | None = None) -> Column:
    """The value of the first attribute of that local name: without a prefix, or in ``namespace``."""
    fits = lambda a: (a["local_name"] == local_name) & (a["prefix"].isNull() & ~a["name"].startswith("xmlns") if namespace is None else a["namespace"] == namespace)
    return F.get(F.filter(attributes, lambda a: F.coalesce(fits(a), F.lit(False))), F.lit(0))["value"]
