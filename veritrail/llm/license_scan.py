"""Operator 10: licence scan by the Dice coefficient over word bigrams.

Every line of a text is normalised (lower case; every run of anything but
letters and digits is one space) and compared with licence templates by
2|A & B| / (|A| + |B|) over distinct word bigrams. As |A & B| <= min(|A|, |B|),
a score of t needs |A| between t/(2-t) and (2-t)/t times |B|. A line of w words,
d of them distinct, has between d-1 and w-1 bigrams, so most lines are left
before any bigram is made. A match shares so many bigrams with its template that
it has one of a few of them, whichever these are; the rarest are taken as anchors,
and all bigrams of a text meet the anchors by hash first. Texts that hold one meet
the templates in a hash join on bigrams with the bounds of each template, so a line
that shares no bigram with a template of a fitting size is never compared.

A notice that is wrapped over lines, or stands inside a longer line, is found in
a second pass over windows of the whole text's words. A template's bigrams give
places in the text; those that lie within one stretch of the template's longest
window are scored as soon as they could be enough. The best window of a template begins where
a row of such places begins and ends where one ends, as a shared bigram more
never lowers the score, so only those are scored. Of windows that overlap, the
one that shares most bigrams is reported, then the best, then the smallest id.
A window within a line that matches by itself, or over one that matches the same
template, is not reported again.

Returns one row per match: doc_id, line_no (from 0, where it begins), template_id,
license, score. For a line the best template is named, of equal ones the smallest id.

Cases: null and empty texts have no match, nor has a line of fewer than two
words; repeated rows are each reported; a null doc_id is kept; other columns
are left out; without templates nothing matches.

Native: SQL functions only. Template bigrams are broadcast only while a bounded
count says that they are few. Only bigrams that a template holds are shuffled,
summed on the map side first, so common lines cost no more than one row a task
and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritrail.llm.licenses import NOTICES, TEMPLATES
from veritrail.llm.lineage import cut

THRESHOLD = 0.8
BROADCAST_BIGRAMS = 200_000
#: Texts that are looked at again for windows; fewer are found by their keys without a shuffle.
BROADCAST_KEYS = 200_000


def default_templates(spark: SparkSession) -> DataFrame:
    """Those with ``whole`` are met by windows alone, a line that holds one included; lines would all fit their size."""
    return spark.createDataFrame([(*t, False) for t in TEMPLATES] + [(*t, True) for t in NOTICES], "template_id string, license string, notice string, whole boolean")


def normalised(text: Column) -> Column:
    """Lower-case words, single spaces; line breaks stay."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")


def words_of(line: Column) -> Column:
    return F.split(F.trim(line), " ")


def adjacent(words: Column) -> Column:
    """Adjacent word pairs; none for fewer than two words."""
    return F.transform(F.slice(words, 2, F.size(words)), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))


def bigrams(words: Column) -> Column:
    """Distinct adjacent word pairs."""
    return F.array_distinct(adjacent(words))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is made once; written into a lambda, it would be made for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def _all_words(text: Column) -> Column:
    """The words of the whole text, over line breaks."""
    return words_of(F.regexp_replace(normalised(text), "[ \n]+", " "))


def _joined(templates: DataFrame) -> DataFrame:
    """The templates with each notice as one line of words."""
    return templates.withColumn("notice", F.array_join(_all_words(F.col("notice")), " "))


def _template_bigrams(templates: DataFrame, threshold: float) -> DataFrame:
    pairs = F.flatten(F.transform(F.split(normalised(F.col("notice")), "\n"), lambda line: bigrams(words_of(line))))
    sized = templates.select("template_id", "license", F.array_distinct(pairs).alias("_pairs"))
    size = F.size("_pairs")
    return sized.select(
        "template_id",
        "license",
        size.alias("t_size"),
        F.ceil(size * F.lit(threshold / (2 - threshold)) - F.lit(1e-9)).cast("int").alias("t_low"),
        F.floor(size * F.lit((2 - threshold) / threshold) + F.lit(1e-9)).cast("int").alias("t_high"),
        F.explode_outer("_pairs").alias("t_pair"),
    ).where("t_pair IS NOT NULL")


def _pair_hashes(text: Column) -> Column:
    """Hashes of the adjacent word pairs of the whole text, over line breaks; a first or last empty word pairs with nothing known."""
    hashed = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))
    return _once(hashed, lambda k: F.transform(F.slice(k, 2, F.size(k)), lambda x, i: F.xxhash64(F.get(k, i), x)))


def _anchors(table: DataFrame, threshold: float) -> DataFrame:
    """Hashes (k) of bigrams of which every match holds one.

    A match shares at least m = threshold * (|B| + t_low) / 2 bigrams with its
    template, so of any |B| - m + 1 of them it has one. Those that fewest
    templates hold are taken, of these the longest.
    """
    least = F.greatest(F.lit(1), F.ceil(F.lit(threshold / 2) * (F.col("t_size") + F.col("t_low")) - F.lit(1e-9)))
    common = table.groupBy("t_pair").agg(F.count(F.lit(1)).alias("_uses"))
    order = Window.partitionBy("template_id").orderBy("_uses", F.desc(F.length("t_pair")), "t_pair")
    ranked = table.join(common, "t_pair").withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= F.col("t_size") - least + 1)
    word = lambda i: F.xxhash64(F.get(F.split("t_pair", " "), i))
    return ranked.select(F.xxhash64(word(0), word(1)).alias("k")).distinct()


def _holding(docs: DataFrame, anchors: DataFrame, text: Column, id_col: str) -> DataFrame:
    """_id and _raw of the rows whose text holds an anchor; the others cannot match."""
    if anchors.limit(BROADCAST_BIGRAMS + 1).count() <= BROADCAST_BIGRAMS:
        anchors = F.broadcast(anchors)
    key = ["_no_id", "_key", "_text"]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(id_col).isNull().alias("_no_id"), F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("_key"), F.xxhash64(text).alias("_text"), text.alias("_raw")).where("_raw IS NOT NULL")
    met = rows.select(*key, F.explode_outer(_pair_hashes(F.col("_raw"))).alias("k")).where("k IS NOT NULL").join(anchors, "k").select(*key).distinct()
    met = cut(met)
    if met.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        met = F.broadcast(met)
    return cut(rows.join(met, key, "left_semi").select("_id", "_raw"))


def _windows(docs: DataFrame, templates: DataFrame, threshold: float, text: Column, id_col: str) -> DataFrame:
    """_id, _text, _from and _to (lines), template_id, license, score of the windows that match, for each row of ``docs``."""
    whole = _joined(templates)
    spans = whole.select("template_id", F.floor((F.size(F.split("notice", " ")) - 1) * F.lit((2 - threshold) / threshold) + F.lit(1e-9)).cast("int").alias("t_span"))
    table = _template_bigrams(whole, threshold).join(F.broadcast(spans), "template_id").withColumn("t_k", F.xxhash64("t_pair"))
    if table.limit(BROADCAST_BIGRAMS + 1).count() <= BROADCAST_BIGRAMS:
        table = F.broadcast(table)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_raw"))
    made = rows.select("_id", "_text", _all_words(F.col("_raw")).alias("_words")).select("_id", "_text", F.posexplode_outer(adjacent(F.col("_words"))).alias("_pos", "_pair"))
    stretch = F.expr("_pos div t_span").cast("int")
    met = made.join(table, F.col("_pair") == F.col("t_pair")).select("_id", "_text", "template_id", "license", "t_size", "t_low", "t_span", "_pos", "t_k", F.explode(F.array(stretch, stretch - 1)).alias("_stretch"))
    near = met.groupBy("_id", "_text", "template_id", "license", "t_size", "t_low", "t_span", "_stretch").agg(F.collect_set(F.struct("_pos", "t_k")).alias("_hits"))
    enough = near.where(F.size(F.array_distinct("_hits.t_k")) >= F.lit(threshold / 2) * (F.col("t_size") + F.col("t_low")) - F.lit(1e-9))
    chosen = cut(enough.groupBy("_id", "_text").agg(F.collect_list(F.struct("template_id", "license", "t_size", "t_low", "t_span", F.array_sort("_hits").alias("hits"))).alias("_near")).withColumnsRenamed({"_id": "_c_id", "_text": "_c_text"}))
    same = F.col("_id").eqNullSafe(F.col("_c_id")) & (F.col("_text") == F.col("_c_text"))
    if chosen.count() <= BROADCAST_KEYS:  # else the texts are shuffled
        rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_raw")).join(F.broadcast(chosen.select("_c_id", "_c_text")), same, "left_semi")
    again = rows.join(chosen, same)
    lines = F.transform(F.split(normalised(F.col("_raw")), "\n"), lambda x: F.trim(x))
    line_of = F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i, F.when(x == "", 0).otherwise(F.size(F.split(x, " "))))))

    def scored(m: Column, words: Column) -> Column:
        """Every window of one stretch from the beginning of a row of places to the end of one."""
        at = m["hits"]["_pos"]
        begins, ends = F.array_except(at, F.transform(at, lambda p: p + 1)), F.array_except(at, F.transform(at, lambda p: p - 1))
        fits = lambda b, ends: F.filter(ends, lambda e: (e - b < m["t_span"]) & (e - b + 1 >= m["t_low"]))
        spans = _once(ends, lambda ends: F.flatten(F.transform(begins, lambda b: F.transform(fits(b, ends), lambda e: F.struct(b.alias("b"), e.alias("e"))))))
        shared = lambda w: F.size(F.array_distinct(F.transform(F.filter(m["hits"], lambda h: h["_pos"].between(w["b"], w["e"])), lambda h: h["t_k"])))
        counted = F.transform(spans, lambda w: F.struct(w["b"].alias("b"), w["e"].alias("e"), shared(w).alias("s")))
        likely = F.filter(counted, lambda w: 2.0 * w["s"] >= F.lit(threshold) * (m["t_size"] + m["t_low"]) - F.lit(1e-9))
        score = lambda w: 2.0 * w["s"] / (F.size(bigrams(F.slice(words, w["b"] + 1, w["e"] - w["b"] + 2))) + m["t_size"])
        return F.transform(likely, lambda w: F.struct((-w["s"]).alias("less"), (-score(w)).alias("worse"), m["template_id"].alias("template_id"), w["b"].alias("b"), w["e"].alias("e"), m["license"].alias("license")))

    good = _once(_all_words(F.col("_raw")), lambda words: F.filter(F.flatten(F.transform("_near", lambda m: scored(m, words))), lambda w: -w["worse"] >= threshold))
    # From the best on, each window that meets no better one; windows meet if they share a word.
    free = lambda kept, w: ~F.exists(kept, lambda k: (k["b"] <= w["e"] + 1) & (w["b"] <= k["e"] + 1))
    kept = _once(F.array_sort(F.array_distinct(good)), lambda g: F.aggregate(g, F.slice(g, 1, 0), lambda a, w: F.when(free(a, w), F.concat(a, F.array(w))).otherwise(a)))
    placed = _once(line_of, lambda at: F.transform(kept, lambda w: F.struct(w.alias("w"), F.get(at, w["b"]).alias("from"), F.get(at, w["e"] + 1).alias("to"))))
    flat = again.select("_id", "_text", F.explode_outer(placed).alias("_w")).where("_w IS NOT NULL")
    return flat.select("_id", "_text", F.col("_w.from").alias("_from"), F.col("_w.to").alias("_to"), F.col("_w.w.template_id").alias("template_id"), F.col("_w.w.license").alias("license"), (-F.col("_w.w.worse")).alias("score"))


def scan(docs: DataFrame, templates: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    table = _template_bigrams(templates.where("NOT whole") if "whole" in templates.columns else templates, threshold)
    joined = _template_bigrams(_joined(templates), threshold)
    holding = _holding(docs, _anchors(table, threshold).union(_anchors(joined, threshold)).distinct(), F.col(text_col).cast("string"), id_col)
    text = F.col("_raw")
    bounds = table.agg(F.min("t_low"), F.max("t_high"), F.count(F.lit(1))).first()
    low, high, n_pairs = bounds[0] or 1, bounds[1] or 0, bounds[2]
    # What each line carries along is made once per text, before lines and bigrams are dealt out.
    texts = holding.select("_id", F.xxhash64(text).alias("_text"), F.split(normalised(text), "\n").alias("_lines"))
    lines = texts.select("_id", "_text", F.posexplode_outer("_lines").alias("_line", "_raw")).withColumn("_raw", F.trim("_raw"))
    gaps = F.length("_raw") - F.length(F.replace("_raw", F.lit(" ")))  # one less than the words
    fitting = lines.where((gaps >= low) & ((gaps <= high) | (F.size(F.array_distinct(F.split("_raw", " "))) - 1 <= high)))
    pairs = fitting.select("_id", "_text", "_line", F.split("_raw", " ").alias("_words")).select("_id", "_text", "_line", bigrams(F.col("_words")).alias("_pairs"))
    made = pairs.select("_id", "_text", "_line", F.size("_pairs").alias("_size"), "_pairs").select("_id", "_text", "_line", "_size", F.explode_outer("_pairs").alias("_pair"))  # outer, else Spark would make the list again to test its size
    if n_pairs <= BROADCAST_BIGRAMS:
        table = F.broadcast(table)
    # As a CASE the bounds give Spark no null test to push below, where it would make every list again.
    met = made.join(table, F.col("_pair") == F.col("t_pair")).where(F.when(F.col("_size").between(F.col("t_low"), F.col("t_high")), True).otherwise(False))
    counted = met.groupBy("_id", "_text", "_line", "_size", "template_id", "license", "t_size").agg(F.collect_set("_pair").alias("_set"), F.count(F.lit(1)).alias("_n"))
    shared = F.size("_set")
    scored = counted.withColumn("_shared", shared).withColumn("score", 2.0 * F.col("_shared") / (F.col("_size") + F.col("t_size")))
    good = scored.where(F.col("score") >= threshold)
    best = good.groupBy("_id", "_text", "_line").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "template_id", "license")).alias("_best"),
        F.min(F.expr("_n div _shared")).alias("_copies"),  # each copy of a row brought all shared bigrams once
    )
    # Few rows by now; they are read twice below.
    by_line = cut(best.select("_id", "_text", "_line", "_best.template_id", "_best.license", (-F.col("_best.s")).alias("score"), "_copies"))
    own = by_line.groupBy("_id", "_text").agg(F.collect_list(F.struct("_line", "template_id")).alias("_own")).withColumnsRenamed({"_id": "_o_id", "_text": "_o_text"})
    windows = _windows(holding, templates, threshold, text, "_id").join(own, F.col("_id").eqNullSafe(F.col("_o_id")) & (F.col("_text") == F.col("_o_text")), "left")
    said = F.exists("_own", lambda x: x["_line"].between(F.col("_from"), F.col("_to")) & ((F.col("_from") == F.col("_to")) | (x["template_id"] == F.col("template_id"))))
    rest = windows.where(~F.coalesce(said, F.lit(False)))
    columns = ["template_id", "license", "score"]
    copied = by_line.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return copied.select(F.col("_id").alias(id_col), F.col("_line").cast("long").alias("line_no"), *columns).unionByName(rest.select(F.col("_id").alias(id_col), F.col("_from").cast("long").alias("line_no"), *columns))


def duckdb_sql(threshold: float = THRESHOLD) -> str:
    """The line matches of TEMPLATES alone: neither windows nor NOTICES."""
    rows = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in TEMPLATES)
    norm = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
WITH t0(template_id, license, notice) AS (VALUES {rows}),
t AS (SELECT template_id, license, {pairs.format("w")} AS b FROM (SELECT *, string_split({norm.format("notice")}, ' ') AS w FROM t0)),
l0 AS (SELECT doc_id, string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), chr(10)) AS ls FROM documents),
l1 AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l0),
l AS (SELECT doc_id, line_no, {pairs.format("w")} AS b FROM (SELECT doc_id, line_no, string_split(trim(line), ' ') AS w FROM l1)),
s AS (SELECT doc_id, line_no, template_id, license, 2.0::DOUBLE * len(list_intersect(l.b, t.b)) / (len(l.b) + len(t.b)) AS score FROM l, t WHERE len(l.b) > 0)
SELECT doc_id, line_no, template_id, license, score FROM s WHERE score >= {threshold}
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY score DESC, template_id) = 1""".replace("\\\\", "\\")
