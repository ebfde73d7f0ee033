"""Operator 3: benchmark decontamination by template canonicalisation.

Texts become templates: numbers in digits or words, units after a number, and
names (capitalised words, several in a row being one) turn into typed
placeholders, the rest into lower-case words. A word that begins a sentence is a
name as well: whether it is one cannot be told there, and it is the same in every
copy, or stands for one value as a name does. Windows of ``WINDOW`` = 5 template
words are joined by hash with those of the benchmark items, so a question asked
again with other numbers or names still meets its original. A window of
placeholders alone says nothing and keeps its values, so it meets only copies.

An item leaks into a document if at least ``SHARE`` = 0.8 of its windows occur
within one stretch of the document, and its slots are consistent there: each
slot value of the item stands for one value of the document, and each of these
for one of the item, in at least ``SHARE`` of their uses. A window that occurs
several times in a stretch is taken where it lies in line with the most others,
so neither repeated phrases of an item nor variants that follow each other vote
against themselves, and a copy always agrees with itself.

Search: of an item with W windows, a leak lacks W - ceil(SHARE * W) at most, so
of any one more than that it has one. The rarest in the benchmark are taken as
anchors. Every window of every document meets the anchors; only documents met so
get their windows made with slots, and only met items are compared further.

Returns one row per leak: doc_id, item_id, share, consistency and kind,
``verbatim`` if every slot keeps its value, else ``reparameterised``.

Cases: null and empty texts have no leak; an item of fewer than WINDOW words,
or a null one, has no window and leaks nowhere; rows that share doc_id and text
are one document and give one row per item; a null doc_id is kept as null;
items with one text are each reported, and rows that share item_id but not the
text are items of their own, of which the best is reported; a null item_id leaks
nowhere; other columns are left out.

Native: SQL functions only. Anchors, and the keys of documents met, are broadcast
only while a bounded count says that they are few, and shuffled beyond that; then
a hot anchor is a skewed key of a plain join, which Spark splits. Windows that
meet no anchor never leave their task when anchors are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrail.llm.lineage import cut

WINDOW = 5
SHARE = 0.8
BROADCAST_ANCHORS = 500_000
BROADCAST_KEYS = 200_000
#: Unit words that become a placeholder after a number.
UNITS = ["km", "m", "cm", "mm", "kg", "g", "mg", "s", "ms", "min", "h", "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?", "miles?", "metres?", "meters?", "feet", "inches", "dollars?", "euros?", "cents?", "percent", "litres?", "liters?", "degrees?"]

#: Marks around a number, before a unit, around a name; \\u0004 joins what a number holds.
NUMBER, UNIT, NAME, JOIN = "\u0001", "\u0002", "\u0003", "\u0004"
_UNIT = f"(?:{'|'.join(UNITS)})"
#: Numbers in words.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]
_NUMBER = f"(?:[0-9][0-9{JOIN}]*+|{'|'.join(NUMBER_WORDS)})"
#: A capitalised word; the capital comes first, as most places fail there at once.
_NAME = r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}"


def tokens(text: Column) -> Column:
    """The words of a text; slots begin with their type's mark."""
    digits = text.rlike("[0-9]")
    named = F.regexp_replace(text, _NAME, f"{NAME}$0")
    joined = F.when(digits, F.regexp_replace(named, "(?<=[0-9])[.,](?=[0-9])", JOIN)).otherwise(named)
    plain = F.trim(F.regexp_replace(F.lower(joined), f"[^\\p{{L}}\\p{{N}}{NAME}{JOIN}]+", " "))
    whole = F.replace(F.regexp_replace(plain, f"{NAME}([^ ]+)", f"{NAME}$1{NAME}"), F.lit(f"{NAME} {NAME}"), F.lit("_"))
    numbered = F.regexp_replace(whole, f"(?<![^ ]){_NUMBER}(?![^ ])", f"{NUMBER}$0{NUMBER}")
    return F.split(F.regexp_replace(numbered, f"(?<={NUMBER} ){_UNIT}(?![^ ])", f"{UNIT}$0"), " ")


def is_slot(token: Column) -> Column:
    return token < JOIN


def _once(value: Column, use) -> Column:
    """``use`` of a value that is made once; written into a lambda, it would be made for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def window_hashes(tokens_: Column) -> Column:
    """The hash of every window. A word counts by its hash, a slot by its type's number; windows of slots alone by their values."""

    def of(t: Column) -> Column:
        typed = F.transform(t, lambda w: F.when(is_slot(w), F.ascii(w).cast("long")).otherwise(F.xxhash64(w)))

        def windows(k: Column) -> Column:
            slots = lambda i: F.get(k, i).between(1, 3)
            alone = lambda i: slots(i) & slots(i + 1) & slots(i + 2) & slots(i + 3) & slots(i + 4)
            values = lambda i: F.xxhash64(F.lit(0), *[F.get(t, i + j) for j in range(WINDOW)])
            return F.transform(F.slice(k, 1, F.greatest(F.size(k) - (WINDOW - 1), F.lit(0))), lambda x, i: F.when(alone(i), values(i)).otherwise(F.xxhash64(x, *[F.get(k, i + j) for j in range(1, WINDOW)])))

        return _once(typed, windows)

    return _once(tokens_, of)


def _windows(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Every window of the column ``text``: keep..., total, n_words, pos (from 0), h, slots ARRAY<STRING> (its slot values in order)."""
    split = rows.select(*keep, tokens(F.col("text")).alias("t"))
    made = split.select(*keep, F.size("t").alias("n_words"), "t", window_hashes(F.col("t")).alias("hs"))
    slots = lambda i: F.filter(F.slice("t", i + 1, WINDOW), is_slot)
    # Windows are made within the row, so that a long text is not carried along with each of them.
    sized = made.select(*keep, F.size("hs").alias("total"), "n_words", F.transform("hs", lambda h, i: F.struct(i.alias("pos"), h.alias("h"), slots(i).alias("slots"))).alias("w"))
    # The outer form keeps Spark from testing the list's size below, where it would make the list anew for every window.
    return sized.select(*keep, "total", "n_words", F.inline_outer("w")).where("pos IS NOT NULL")


def _item_windows(items: DataFrame, item_col: str, text_col: str, share: float) -> DataFrame:
    """item, i_hash, total, n_words, pos, h, slots, anchor."""
    text = F.col(text_col).cast("string")
    rows = items.select(F.col(item_col).alias("item"), F.xxhash64(text).alias("i_hash"), text.alias("text")).where("item IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item", "i_hash"])
    made = _windows(rows, ["item", "i_hash"])
    common = made.groupBy("h").agg(F.count(F.lit(1)).alias("uses"))
    order = Window.partitionBy("item", "i_hash").orderBy("uses", "pos")
    ranked = made.join(common, "h").withColumn("place", F.row_number().over(order))
    least = F.ceil(F.col("total") * F.lit(share) - F.lit(1e-9))
    return ranked.withColumn("anchor", F.col("place") <= F.col("total") - least + 1).drop("uses", "place")


def leaks(docs: DataFrame, items: DataFrame, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_anchors: int = BROADCAST_ANCHORS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    windows = cut(_item_windows(items, item_col, item_text, share))
    anchors = windows.where("anchor").select("h", "item", "i_hash")
    if anchors.limit(broadcast_anchors + 1).count() <= broadcast_anchors:
        anchors = F.broadcast(anchors)
    text = F.col(text_col).cast("string")
    raw = F.col(id_col).cast("long")
    doc_key, item_key = ["no_id", "key", "hash"], ["item", "i_hash"]
    rows = docs.select(raw.isNull().alias("no_id"), F.coalesce(raw, F.lit(0)).alias("key"), F.xxhash64(text).alias("hash"), text.alias("text"))
    met = rows.select(*doc_key, F.explode_outer(window_hashes(tokens(F.col("text")))).alias("h")).where("h IS NOT NULL").join(anchors, "h").select(*doc_key, *item_key).distinct()
    met = cut(met)
    keys = met.select(*doc_key).distinct()
    if keys.limit(broadcast_keys + 1).count() <= broadcast_keys:
        keys = F.broadcast(keys)
    again = rows.join(keys, doc_key, "left_semi").dropDuplicates(doc_key)
    own = _windows(again, doc_key).select(*doc_key, F.col("pos").alias("d_pos"), "h", F.col("slots").alias("d_slots"))
    wanted = met.join(windows.drop("anchor"), item_key)
    hits = wanted.join(own, [*doc_key, "h"]).repartition(*doc_key, *item_key)  # the groupings below keep this partitioning
    # A stretch is twice an item long and begins at every length of one, so any copy lies within one.
    stretch = F.expr("d_pos div n_words").cast("int")
    placed = hits.select(*doc_key, *item_key, "total", "pos", "slots", "d_slots", (F.col("d_pos") - F.col("pos")).alias("line"), F.explode(F.array(stretch, stretch - 1)).alias("stretch"))
    group = [*doc_key, *item_key, "total", "stretch"]
    lines = placed.groupBy(*group, "line").agg(F.count(F.lit(1)).alias("support"), F.collect_list(F.struct("pos", "slots", "d_slots")).alias("w"))
    single = lines.select(*group, "line", "support", F.inline("w")).groupBy(*group, "pos").agg(F.max_by(F.struct("slots", "d_slots"), F.struct("support", -F.col("line"))).alias("w"))
    found = single.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.collect_list("w").alias("w")).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") >= share)
    found = cut(found.select(*group, "share", "w"))  # few rows by now; they are read twice below
    pairs = found.select(*group, F.explode("w").alias("w")).select(*group, F.explode(F.arrays_zip("w.slots", "w.d_slots")).alias("z")).select(*group, F.col("z.slots").alias("a"), F.col("z.d_slots").alias("b"))
    votes = pairs.groupBy(*group, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    forward = votes.groupBy(*group, "a").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.bool_and(F.col("a") == F.col("b")).alias("same"))
    back = votes.groupBy(*group, "b").agg(F.max("n").alias("top"), F.sum("n").alias("all"), F.lit(True).alias("same"))
    sides = forward.select(*group, F.lit(0).alias("side"), "top", "all", "same").unionByName(back.select(*group, F.lit(1).alias("side"), "top", "all", "same"))
    rate = lambda s: F.sum(F.when(F.col("side") == s, F.col("top"))) / F.sum(F.when(F.col("side") == s, F.col("all")))
    fits = sides.groupBy(*group).agg(F.least(rate(0), rate(1)).alias("consistency"), F.bool_and("same").alias("same"))
    judged = found.drop("w").join(fits, group, "left").withColumn("consistency", F.coalesce("consistency", F.lit(1.0))).where(F.col("consistency") >= share)
    one = judged.groupBy(*doc_key, "item").agg(F.max(F.struct("share", "consistency", F.coalesce("same", F.lit(True)).alias("same"))).alias("m"))
    return one.select(
        F.when(~F.col("no_id"), F.col("key")).alias(id_col),
        F.col("hash").alias("text_hash"),
        F.col("item").alias(item_col),
        F.col("m.share").alias("share"),
        F.col("m.consistency").alias("consistency"),
        F.when(F.col("m.same"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def remove_leaking(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_keys: int = BROADCAST_KEYS, **options) -> DataFrame:
    """The rows of ``docs`` into which no item leaks, with all their columns."""
    found = leaks(docs, items, id_col=id_col, text_col=text_col, broadcast_keys=broadcast_keys, **options)
    gone = cut(found.select(F.col(id_col).isNull().alias("no_id"), F.coalesce(id_col, F.lit(0)).alias("key"), F.col("text_hash").alias("hash")).distinct())
    if gone.limit(broadcast_keys + 1).count() <= broadcast_keys:
        gone = F.broadcast(gone)
    raw = F.col(id_col).cast("long")
    keyed = docs.select(F.struct("*").alias("row"), raw.isNull().alias("no_id"), F.coalesce(raw, F.lit(0)).alias("key"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    return keyed.join(gone, ["no_id", "key", "hash"], "left_anti").select("row.*")


def duckdb_sql(share: float = SHARE) -> str:
    """The same rows by joining all windows of all documents with all of all items, without anchors."""
    name = r"regexp_replace({}, '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}})', '\1' || chr(3) || '\2', 'g')"
    words = ", ".join(f"'{w}'" for w in NUMBER_WORDS)
    digits = r"regexp_replace({}, '([0-9])[.,]([0-9])', '\1' || chr(4) || '\2', 'g')"
    plain = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\x03\x04]+', ' ', 'g'))".format(digits.format(digits.format(name.format("text"))))
    whole = rf"replace(regexp_replace({plain}, '\x03([^ ]+)', chr(3) || '\1' || chr(3), 'g'), chr(3) || ' ' || chr(3), '_')"
    last = WINDOW - 1
    slot = "w[1] IN (chr(1), chr(2), chr(3))"
    windows = f"SELECT side, id, x, i, n, CASE WHEN len(list_filter(t[i:i + {last}], lambda w: {slot})) = {WINDOW} THEN '=' || array_to_string(t[i:i + {last}], ' ') ELSE array_to_string(k[i:i + {last}], ' ') END AS h, list_filter(t[i:i + {last}], lambda w: {slot}) AS slots FROM (SELECT *, len(t) AS n, unnest(range(1, len(t) - {last} + 1)) AS i FROM k)"
    group = "doc_id, x, item_id, y, total, stretch"
    return f"""
WITH s AS (SELECT DISTINCT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT DISTINCT 'b', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT side, id, md5(text) AS x, string_split({whole}, ' ') AS w FROM s WHERE text IS NOT NULL),
m AS (SELECT side, id, x, list_transform(w, lambda v: CASE WHEN regexp_full_match(v, '[0-9][0-9\\x04]*') OR v IN ({words}) THEN chr(1) || v || chr(1) ELSE v END) AS w FROM w),
t AS (SELECT side, id, x, list_transform(w, lambda v, i: CASE WHEN i > 1 AND w[i - 1][1] = chr(1) AND regexp_full_match(v, '{_UNIT}') THEN chr(2) || v ELSE v END) AS t FROM m),
k AS (SELECT *, list_transform(t, lambda w: CASE WHEN {slot} THEN w[1] ELSE w END) AS k FROM t),
a AS ({windows}),
j AS (SELECT d.id AS doc_id, d.x AS x, b.id AS item_id, b.x AS y, b.n - {last} AS total, b.i AS pos, b.slots AS p, d.slots AS q, d.i - b.i AS line, (d.i - 1) // b.n - o AS stretch FROM (SELECT * FROM a WHERE side = 'd') AS d JOIN (SELECT * FROM a WHERE side = 'b') AS b USING (h), (VALUES (0), (1)) AS v(o)),
l AS (SELECT *, count(*) OVER (PARTITION BY {group}, line) AS support FROM j),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY {group}, pos ORDER BY support DESC, line) = 1),
f AS (SELECT {group}, count(*) / total AS share FROM o GROUP BY {group} HAVING count(*) / total >= {share}),
z AS (SELECT {group}, unnest(p) AS p, unnest(q) AS q FROM o SEMI JOIN f USING ({group})),
v AS (SELECT {group}, p, q, count(*) AS n FROM z GROUP BY ALL),
c1 AS (SELECT {group}, sum(top) / sum(every) AS rate, bool_and(same) AS same FROM (SELECT {group}, p, max(n) AS top, sum(n) AS every, bool_and(p = q) AS same FROM v GROUP BY ALL) GROUP BY ALL),
c2 AS (SELECT {group}, sum(top) / sum(every) AS rate FROM (SELECT {group}, q, max(n) AS top, sum(n) AS every FROM v GROUP BY ALL) GROUP BY ALL),
g AS (SELECT f.*, coalesce(least(c1.rate, c2.rate), 1.0)::DOUBLE AS consistency, coalesce(same, true) AS same FROM f LEFT JOIN c1 USING ({group}) LEFT JOIN c2 USING ({group})),
r AS (SELECT * FROM g WHERE consistency >= {share} QUALIFY row_number() OVER (PARTITION BY doc_id, x, item_id ORDER BY share DESC, consistency DESC, same DESC) = 1)
SELECT doc_id, item_id, share::DOUBLE AS share, consistency, CASE WHEN same THEN 'verbatim' ELSE 'reparameterised' END AS kind FROM r"""
