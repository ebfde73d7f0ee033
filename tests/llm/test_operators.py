"""Edge cases and brute-force versions of the training-data operators."""

import hashlib
import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritrail.llm import bpe, bpe_codec, components, decontaminate, lang_id, license_scan, pii, queries, simhash, span_dedup, token_count, topk, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} runs{i % 31}." for i in range(20_000))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in each column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(1, None, None), (2, "", "en"), (None, "a few words here", "en"), (3, "a few words here", None), (3, "a few words here", None), (4, LONG, "de"), (5, LONG, "de"), (6, "x" * 50_000, "fr"), (7, " \n\t ", "en")]
    extra = {c: F.lit(1) for c in ("fp", "id", "hash", "key", "row", "no_id", "text_hash", "component_id", "rule", "item", "root", "_text", "n_tokens", "score", "n")}
    return docs(spark, rows).withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# 1 ------------------------------------------------------------------ URL filters


def judge_plain(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = ["http://A.Example.ORG/en/12?x", "https://example.org/es/", "http://org", "http://org/", "http://b.org#f", "ftp://x.COM/fr/a", "http://com/de/", "no scheme", "", None, "http:///p", "a://b://c.com/fr/", "http://xorg/", "http://é.org/en/1", "http://example.org/en/2", "http://u@h.com:8/de/?://z"]


@pytest.mark.parametrize("few", [50_000, 0])
def test_url_filter_against_plain(spark, few):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, URLS[0]), (None, URLS[1])], "page_id long, url string").withColumn("host", F.lit("x"))
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    got = url_filter.judge(pages, rules, broadcast_rules=few).collect()
    assert len(got) == len(URLS) + 2
    want = sorted(repr((i, *judge_plain(u, queries.URL_RULES))) for i, u in [*enumerate(URLS), (0, URLS[0]), (None, URLS[1])])
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == want


def test_url_filter_long_urls(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    urls = ["http://" + "a." * 100_000 + "org/x", "http://example.org/es/" + "y" * 1_000_000, "http://" + "b" * 1_000_000, "http://...example.org./es/", "http://.org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.rule for r in url_filter.judge(pages, rules).select("page_id", "rule").collect()}
    assert got == {i: judge_plain(u, queries.URL_RULES)[2] for i, u in enumerate(urls)}


def test_url_filter_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.judge(pages, none).select("rule", "verdict").first() == (None, "allow")
    clash = spark.createDataFrame([("b", "/c", "allow"), ("b", "/c", "block"), (None, "/", "block"), ("", "/", "block"), ("a.b", None, "allow")], none.schema)
    row = url_filter.judge(pages, clash).first()
    assert (row.rule, row.verdict, row.n_fitting) == ("a.b", "allow", 2)  # equally long: the longer host
    assert url_filter.judge(pages, clash.where("host = 'b'")).first().verdict == "block"
    assert url_filter.judge(pages.limit(0), clash).count() == 0


# 2 -------------------------------------------------------------- substring dedup

PASSAGE = "The quick passage begins right here. It goes on for a good while with more words. Then it ends with this last one. Or so it seemed, as two more sentences were to follow it."


def test_span_dedup(spark):
    rows = [(1, f"Own start one. {PASSAGE} Own end.", None), (2, f"Other.\n{PASSAGE}\nTail here.", None), (3, "Nothing shared at all. Not one bit. Nor this.", None), (4, None, None), (5, "", None), (6, PASSAGE, None), (6, PASSAGE, None)]
    got = {r.doc_id: r for r in span_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert got[2].text == "Other.\nTail here." and got[2].n_removed > 3
    assert got[3].text == rows[2][1]
    assert got[4].text is None and got[5].text == "" and got[5].n_sentences == 0
    assert got[6].text == "" and span_dedup.remove_repeats(docs(spark, rows)).where("doc_id = 6").count() == 2


def _words(rnd, n, stop=0.0):
    return " ".join(rnd.choice("aeiou") * rnd.randint(1, 3) + str(rnd.randint(0, 999)) + ("." if rnd.random() < stop else "") for _ in range(n))


@pytest.mark.parametrize("stop", [0.0, 0.03, 0.1, 0.4])
def test_passages_of_over_fifty_words_hold_a_run(stop):
    """Wherever a passage begins and ends within sentences of other texts, both hold one run of it."""
    rnd = random.Random(int(100 * stop))

    def hashes(text):
        made = span_dedup.sentences(text)
        last = span_dedup.run_ends(made.size)
        return {made.words[a:b] for a, b in zip(made.begin[: len(last)].tolist(), made.end[last].tolist())}

    for k in range(300):
        passage = _words(rnd, rnd.choice([51, 52, 60, 120]), stop)
        if k % 3 == 0:
            passage = " ".join(rnd.choice(["aa", "bb", "cc"]) for _ in range(51))  # ties of length everywhere
        one, two = (" ".join([_words(rnd, rnd.randint(0, 12), stop), passage, _words(rnd, rnd.randint(0, 12), stop)]) for _ in range(2))
        assert hashes(one) & hashes(two)


def test_sentence_ends():
    made = span_dedup.sentences('  He said "stop!" (Then he left.) And «so on…» here\nline 2\r\nend 3.14 no')
    assert len(made.size) == 6 and made.raw[: made.first[0]] == b"  " and made.raw[made.first[0] :] == b"".join(made.raw[a:b] for a, b in zip(made.first, made.first[1:]))
    assert span_dedup.sentences(" \n") is None
    long = span_dedup.sentences("one three five seven nine eleven thirteen fifteen seventeen")
    assert long.size.tolist() == [7, 2] and span_dedup.sentences("。".join("漢" * 40 for _ in range(3))).size.tolist() == [16]


def test_span_dedup_shuffled_path_and_own_repeats(spark):
    line = _words(random.Random(1), 60)
    rows = [(1, f"{line}\n{line}\nthe end", None), (2, f"x y {line} z", None)]
    for bound in (0, 1000):
        got = {r.doc_id: r.text for r in span_dedup.remove_repeats(docs(spark, rows), broadcast_runs=bound).collect()}
        assert got[1].startswith(line) and len(got[1].split()) < 80 and len(got[2].split()) < 20


def test_span_dedup_odd(odd, empty):
    assert span_dedup.remove_repeats(odd).count() == odd.count()
    assert span_dedup.remove_repeats(empty).count() == 0


# 3 --------------------------------------------------------------- decontamination

ITEM = "A train travels 120 km in 3 hours from the city where Anna lives to the sea and back again before night falls."


def test_decontamination(spark):
    other = ITEM.replace("120", "75").replace(" 3 ", " 2 ").replace("Anna", "Marco")
    mixed = ITEM.replace("120", "75").replace("Anna", "Marco") + " " + "Other words follow here."
    rows = [(1, f"Before it. {ITEM} After it.", None), (2, f"Lead in,\n{other}\nand more.", None), (3, "A train travels in some hours to the sea and nothing else of it.", None), (4, None, None), (5, "", None), (None, ITEM, None), (7, mixed, None), (7, mixed, None)]
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, "too short"), (13, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(docs(spark, rows), items).collect()}
    assert got == {(1, 10): "verbatim", (2, 10): "reparameterised", (None, 10): "verbatim", (7, 10): "reparameterised"}
    kept = decontaminate.remove_leaking(docs(spark, rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5] and kept.columns == docs(spark, []).columns


def test_decontamination_slots_must_agree(spark):
    item = "if 5 is taken from 5 and then 5 is added to 5 what is 5 plus 5 here"
    bad = "if 1 is taken from 2 and then 3 is added to 4 what is 6 plus 7 here"
    good = "if 9 is taken from 9 and then 9 is added to 9 what is 9 plus 9 here"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.leaks(docs(spark, [(1, bad, None), (2, good, None)]), items).collect()
    assert [r.doc_id for r in got] == [2]


def test_decontamination_short_items(spark):
    items = spark.createDataFrame([(1, "one short item of six words")], "item_id long, text string")
    rows = [(k, "pad " * k + "one short item of six words and on", None) for k in range(7)]
    assert sorted(r.doc_id for r in decontaminate.leaks(docs(spark, rows), items).collect()) == list(range(7))


def _by_sql(sql, **tables):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name, rows in tables.items():
        connection.register(name, rows.toPandas())
    return connection.execute(sql).fetchdf()


PEN = "Each red box holds 12 pens for the class, each blue box holds 30 pens for the class, each green box holds 45 pens for the class. How many pens?"
SUM = "What is 12 times 7? A) it is equal to 84 B) it is equal to 74 and that is all there is to it"


def test_decontamination_against_sql(spark):
    """Short items changed at any place and phase, items that repeat themselves, worksheets of variants, names of two words, odd digits."""
    rnd = random.Random(6)
    short = ["mako sila tuno reva dolu pesa kiro vanu belo", "tasi gora mela punu siko rade zulo fema nilo kabu", " ".join(f"word{chr(97 + i)}" for i in range(20))]
    items = [*enumerate([*short, PEN, SUM, "we saw that Anna Maria Smith paid 1,000.50 dollars for x1 2b days", "12 13 14 15 16 17 18", "say 5 and 6 and 7 then"])]
    rows = []
    for item in short:
        words = item.split()
        for place in range(len(words)):
            for offset in range(5):
                rows.append(" ".join(["pad"] * offset + words[:place] + ["other"] + words[place + 1 :] + ["more"]))
    rows += [PEN, SUM, "x " + SUM.replace("12", "9").replace("84", "63"), "we saw that Bob paid 7 dollars for x1 2b days"]
    variants = [PEN.replace("12", str(a)).replace("30", str(b)).replace("45", str(c)) for a, b, c in [(1, 2, 3), (4, 5, 6), (7, 8, 9), (10, 11, 13)]]
    rows += [" ".join(rnd.sample(variants, n)) for n in (2, 3, 4) for _ in range(3)]
    rows += ["12 13 14 15 16 17 18", "22 23 24 25 26 27 28", "say 5 and 5 and 5 then", "say 8 and 9 and 1 then", None, "", "12 " * 3000]
    table, bench = docs(spark, [(i, t, None) for i, t in enumerate(rows)]), spark.createDataFrame(items, "item_id long, text string")
    want = {(r.doc_id, r.item_id, round(r.share, 9), round(r.consistency, 9), r.kind) for r in _by_sql(decontaminate.duckdb_sql(), documents=table, benchmark=bench).itertuples()}
    for bound in (0, 500_000):
        found = decontaminate.leaks(table, bench, broadcast_anchors=bound, broadcast_keys=bound).collect()
        assert {(r.doc_id, r.item_id, round(r.share, 9), round(r.consistency, 9), r.kind) for r in found} == want and len(found) == len(want)
    hit = {(rows[d], i): k for d, i, _, _, k in want}
    assert hit[PEN, 3] == hit[SUM, 4] == hit["12 13 14 15 16 17 18", 6] == "verbatim" and hit["x " + SUM.replace("12", "9").replace("84", "63"), 4] == "reparameterised"
    assert all((r, 3) in hit for r in rows if r and r.count("pens for the class") > 3)
    assert ("we saw that Bob paid 7 dollars for x1 2b days", 5) in hit and ("22 23 24 25 26 27 28", 6) not in hit
    assert ("say 5 and 5 and 5 then", 7) not in hit and ("say 8 and 9 and 1 then", 7) in hit
    # Nine words have five windows; a changed first or last word leaves four, which is 0.8.
    assert sum(i == 0 for _, i, *_ in want) == 10


ALICE = "Alice has 3 apples. Bob gives Alice 4 more apples. Alice then eats 2 of them. How many fruits does Alice have with Bob in total?"


def test_renamed_questions(spark):
    """Names that begin sentences and numbers in words are slots as well."""
    named = ALICE.replace("Alice", "Carol").replace("Bob", "Dave")
    copies = [ALICE, ALICE.replace("3", "7").replace("4", "9").replace(" 2 ", " 5 "), named, named.replace("3", "30").replace("4", "six").replace(" 2 ", " eleven ")]
    swapped = ALICE.replace("Bob gives Alice", "Carol gives Dave").replace("does Alice have with Bob", "does Erin have with Frank")
    items = spark.createDataFrame([(1, ALICE)], "item_id long, text string")
    got = {r.doc_id: r.kind for r in decontaminate.leaks(docs(spark, [*enumerate_docs(copies), (9, swapped, None)]), items).collect()}
    assert got == {0: "verbatim", 1: "reparameterised", 2: "reparameterised", 3: "reparameterised"}


def enumerate_docs(texts):
    return [(i, t, None) for i, t in enumerate(texts)]


NAMES = ["Anna", "Marco", "Priya", "Chen", "Omar", "Lucia", "Tom", "Sofia", "Ivan", "Mei"]
PLOTS = [
    "{n} buys {a} {u} of rope at the market. {m} cuts off {b} {u} of it for the boat. How many {u} of rope are left for {n} to use at home?",
    "Each day {n} walks {a} {u} to the old mill and {b} {u} back along the river. How far does {n} walk with {m} in {c} days altogether?",
    "A tank holds {a} litres of water. {n} pours out {b} litres every morning while {m} adds {c} litres at night. When will the tank of {n} be empty?",
    "{n} and {m} share {a} sweets so that {n} gets {b} more than {m}. After that {m} loses {c} sweets on the way. How many does {m} still hold?",
]


@pytest.mark.parametrize("changed", ["numbers", "names", "units", "all"])
def test_recall_of_reparameterised_items(spark, changed):
    rnd = random.Random(changed)
    pick = lambda: {"n": rnd.choice(NAMES[:5]), "m": rnd.choice(NAMES[5:]), "a": rnd.randint(50, 99), "b": rnd.randint(10, 49), "c": rnd.randint(2, 9), "u": rnd.choice(["km", "miles", "metres"])}
    keys = {"numbers": "abc", "names": "nm", "units": "u", "all": "nmabcu"}[changed]
    made, clean = [], []
    for i in range(60):
        base = pick()
        body = PLOTS[i % 4] + " " + _words(rnd, 12, 0.1).capitalize()
        other = base | {k: v for k, v in pick().items() if k in keys}
        made.append((i, body.format(**base), f"{_words(rnd, 30, 0.1)}. {body.format(**other)} {_words(rnd, 30, 0.1)}"))
        clean.append((1000 + i, f"{_words(rnd, 40, 0.1)}. {rnd.choice(NAMES)} walks {rnd.randint(1, 99)} km. {_words(rnd, 40, 0.1)}", None))
    items = spark.createDataFrame([(i, item) for i, item, _ in made], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs(spark, [(i, t, None) for i, _, t in made] + clean), items).collect()}
    recall = sum((i, i) in got for i, _, _ in made) / len(made)
    print(changed, "recall", recall)
    assert recall >= 0.9 and not [d for d, _ in got if d >= 1000]


def test_decontamination_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, LONG[:300])], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(odd, items).collect()} == {4, 5}
    assert decontaminate.leaks(empty, items).count() == 0
    assert decontaminate.remove_leaking(odd, items.limit(0)).count() == odd.count()


# 4, 7 ----------------------------------------------------------------- tokenizers

PIECES = ["a", "B", " ", "\n", "é", "Σ", "ΑΣ", "İ", "\x1c", "\x85", "\u00a0", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", "123", "½", "漢字", "😀", "…", "\r\n", "\u2028", "ﬁ", "th", "tion", "  ", "K"]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    return [*made, LONG[:20_000], "x" * 3000, "thetionof" * 500]


def test_codec_equals_library(texts):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe_codec.codec(path)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == library.decode(want.ids, skip_special_tokens=False)


def test_counts_equal_library(texts):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), token_count.counter(path)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert own.count(text) == len(want.ids)


def test_short_and_long_merges_agree():
    P = pytest.importorskip("public_tokenizers")
    vocabulary, rnd = bpe.Vocabulary(P.path("byte_bpe_50k.json")), random.Random(2)
    for _ in range(300):
        ids = vocabulary.symbols("".join(rnd.choice("thein oan") for _ in range(rnd.randint(0, 60))))
        short = bpe.merge_short(ids, vocabulary)
        assert short == bpe.merge_long(ids, vocabulary) and len(ids) - bpe.count_merges(ids, vocabulary) == len(short)


def test_tokenizer_operators_odd(odd, empty):
    P = pytest.importorskip("public_tokenizers")
    word, byte = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
    got = bpe_codec.round_trip(odd, word, keep_ids=True).collect()
    assert len(got) == odd.count() and all(len(r.ids) == r.n_tokens for r in got)
    none = hashlib.sha256(b"").hexdigest()
    assert {(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got if r.doc_id in (1, 2, 7)} == {(0, none, none)}
    encoded = bpe_codec.encode(odd, word)
    assert {r.text for r in bpe_codec.decode(encoded, word).where("doc_id = 3").collect()} == {"a</w> few</w> words</w> here</w>"}
    counts = {r.doc_id: r for r in token_count.count_tokens(odd, byte).collect()}
    assert (counts[1].n_bytes, counts[1].n_tokens, counts[1].over_limit) == (0, 0, False) and counts[4].over_limit
    assert bpe_codec.round_trip(empty, word).count() == token_count.count_tokens(empty, byte).count() == 0


# 5 ------------------------------------------------------------------- language ID


def test_language_id_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang_id.predict(table, lang_id.train(table)).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97
    assert got.rejected.mean() < 0.02 and got.score.between(0, 1).all()


def test_language_id_odd(spark, odd, empty):
    model = lang_id.train(odd)
    got = lang_id.predict(odd, model).collect()
    assert len(got) == odd.count()
    assert {(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id in (1, 2, 7)} == {("und", 1.0, True)}
    assert lang_id.keep_known(odd, model).columns == odd.columns
    nothing = lang_id.train(empty)
    assert {r.lang_pred for r in lang_id.predict(odd, nothing).collect()} == {"und"} and lang_id.keep_known(odd, nothing).count() == 0
    assert lang_id.predict(empty, model).count() == 0


def test_language_id_learns_every_language_and_ignores_row_order(spark):
    rnd = random.Random(2)
    names = [f"l{k:02}" for k in range(70)]
    rows = [(70 * j + k, " ".join(rnd.choice([f"q{name}", f"{name}zz", name * 2]).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(12)), name) for j in range(8) for k, name in enumerate(names)]
    rows += rows[:70]  # repeated rows count once
    one = lang_id.train(docs(spark, rows), sample=400)
    two = lang_id.train(docs(spark, random.Random(3).sample(rows, len(rows))).repartition(7), sample=400)
    assert one.languages == names and (one.weights == two.weights).all() and (one.cut, one.temperature) == (two.cut, two.temperature)
    got = lang_id.predict(docs(spark, rows), one).collect()
    by_id = {r.doc_id: r for r in got}
    assert sum(by_id[i].lang_pred == lang for i, _, lang in rows) > 0.9 * len(rows)
    for i, text, _ in rows[:50]:  # a plain version of the prediction
        counts = lang_id.subwords(text)
        logits = [(sum(counts[b] * one.weights[b, k] for b in np.flatnonzero(counts)) / counts.sum() + one.bias[k]) / one.temperature for k in range(70)]
        odds = np.exp(np.array(logits) - max(logits))
        assert by_id[i].lang_pred == names[int(odds.argmax())] and by_id[i].score == pytest.approx((odds / odds.sum()).max(), abs=1e-6)


def test_subwords_count_whole_texts(monkeypatch):
    text = "één Straße und " * 400
    whole = lang_id.subwords(text)
    monkeypatch.setattr(lang_id, "PIECE", 64)
    assert (lang_id.subwords(text) == whole).all() and whole.sum() > 3 * 4000


# 6 ----------------------------------------------------------------------------- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    import re

    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_against_patterns():
    rnd = random.Random(3)
    for _ in range(20_000):
        text = "".join(rnd.choice("aB@@..123+- ()%4025\né") for _ in range(rnd.randint(0, 30)))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("1" * 100_000, "a" * 100_000 + "@", "1." * 50_000, "@a" * 50_000, "+" * 50_000):
        pii.base_spans(text)


def test_skip_edges_carry_labels():
    alone = np.full((pii.FEATURES, 5), 0.0)
    skip = np.log(np.full((5, 5), 0.02) + np.eye(5))
    field = pii.Field(alone, np.zeros((5, 5)), skip)
    text = "call +1 (974) 555-3436 now. " + "filler words " * 50 + "again 1 (974) 555-3436 and +1(974)5553436 or 974-555-3436 but 12."
    base = pii.base_spans(text)
    assert [k for k, *_ in base] == ["phone", "phone"]
    more = pii.added_spans(text, base, field)
    assert "974-555-3436" in [text[a:b] for _, a, b in more] and all("12." not in text[a:b] for _, a, b in more)
    assert pii.added_spans("no evidence 974-555-3436", [], field) == []


def test_texts_without_base_spans_are_judged(spark):
    """Two numbers side by side hide each other from the base patterns, and no other span is evidence."""
    unary = np.zeros((pii.FEATURES, 5))
    unary[pii._bucket("luhn True"), pii.LABELS.index("card")] = 9.0
    field = pii.Field(unary, np.zeros((5, 5)), np.zeros((5, 5)))
    text = "paid 12345678 4111111111111111 for 12"
    assert pii.base_spans(text) == []
    assert [(k, text[a:b]) for k, a, b in pii.added_spans(text, [], field)] == [("card", "4111111111111111")]
    assert pii.masked_text(text, field) == "paid 12345678 <card> for 12"
    got = pii.find(docs(spark, [(1, text, None)]), field).first()
    assert (got.n_card, got.n_added, got.spans) == (0, 1, "card:14:30")


def test_beliefs_are_exact_on_trees():
    """Without loops the messages give the marginals of the field, here found by going through all labellings."""
    from itertools import product

    rng = np.random.default_rng(3)
    for text in ("12 34 56", "12 ab 12 cd 34", "77 x 88 y 77 88", "5551234567 a 1234567 b 99"):
        found = pii.tokens(text)
        field = pii.Field(rng.normal(size=(pii.FEATURES, 5)) / 4, rng.normal(size=(5, 5)), rng.normal(size=(5, 5)))
        chain, skip = pii.edges(found)
        if len(chain) + len(skip) >= len(found):
            continue
        local = np.array([field.unary[t.features].sum(axis=0) for t in found])
        exact = np.zeros_like(local)
        for labels in product(range(5), repeat=len(found)):
            score = sum(local[i, k] for i, k in enumerate(labels)) + sum(field.chain[labels[i], labels[j]] for i, j in chain) + sum(field.skip[labels[i], labels[j]] for i, j in skip)
            exact[range(len(found)), labels] += np.exp(score)
        assert np.allclose(pii.beliefs(field, found, rounds=80), exact / exact.sum(axis=1, keepdims=True), atol=1e-6)


def test_added_spans_are_repeats_of_known_ones(spark):
    """Of the spans that a trained field adds to planted texts, all repeat a base span, and no other number is taken."""
    field = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rnd, right, wrong, planted = random.Random(4), 0, 0, 0
    for _ in range(200):
        number = "".join(rnd.choice("23456789") for _ in range(10))
        others = [str(rnd.randint(1, 99_999)) for _ in range(4)]
        text = f"call +1{number} today, room {others[0]}, page {others[1]} and then {number} or {others[2]} times {others[3]}"
        added = pii.added_spans(text, pii.base_spans(text), field)
        planted += 1
        right += any(text[a:b] == number for _, a, b in added)
        wrong += sum(text[a:b] != number for _, a, b in added)
    assert wrong == 0 and right > 0.9 * planted


def test_pii_odd(spark, odd, empty):
    field = pii.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = pii.find(odd, field).collect()
    assert len(got) == odd.count() and {r.base_sha256 for r in got if r.doc_id == 1} == {hashlib.sha256(b"").hexdigest()}
    assert pii.train(empty) is None and pii.find(empty, None).count() == 0
    rows = docs(spark, [(1, "me a.b@c.de and 4111 1111 1111 1111!", None), (2, None, None), (3, "", None)])
    masked = {r.doc_id: r.text for r in pii.mask(rows, field).collect()}
    assert masked == {1: "me <email> and <card>!", 2: None, 3: ""}


# 8 --------------------------------------------------------------------------- top-k


@pytest.mark.parametrize(("candidates", "asked"), [(8192, 1024), (7, 3)])
def test_topk_against_brute_force(spark, candidates, asked):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(120, 9)).round(2)
    vectors[30:60] = vectors[0]  # a large group of copies
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(vectors)] + [(500, None, 0), (501, [1.0, None] + [0.0] * 7, 0), (502, [float("nan")] * 9, 0), (503, [float("inf")] * 9, 0), (None, [1.0] * 9, 0), (0, [float(x) for x in vectors[0]], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(7)).withColumn("v", F.lit(1))
    got = sorted(map(tuple, topk.top_k(table, F.col("id") % 10 == 0, k=5, candidates=candidates, queries=asked).collect()))
    whole = np.floor(256 * vectors).astype(np.int64)
    want = []
    for q in range(0, 120, 10):
        order = sorted((-int(whole[q] @ whole[c]), c) for c in range(120) if c != q)[:5]
        want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(order)]
    assert got == sorted(want)


def test_topk_lists_send_what_the_threshold_asks(spark):
    """Tasks of phase 2 hold parts of one slice, and send those of a SLICES-th of the cutoff alone."""
    rng = np.random.default_rng(9)
    parts = rng.integers(-50, 50, (3, topk.SLICES, 40))  # query, slice, candidate
    whole, k = parts.sum(axis=1), 4
    cuts = np.sort(whole, axis=1)[:, -k]
    rows = [[np.flatnonzero(parts[q, s] >= topk.share(cuts)[q]) for q in range(3)] for s in range(topk.SLICES)]
    places = [np.concatenate([q * 40 + r for q, r in enumerate(of)]) for of in rows]
    values = [parts[p // 40, s, p % 40] for s, p in enumerate(places)]
    open_ = set(topk.open_entries(places, values, cuts, 40, k).tolist())
    assert {q * 40 + c for q in range(3) for c in range(40) if whole[q, c] >= cuts[q]} <= open_
    assert len(open_) < sum(map(len, places)) < 3 * 40 * topk.SLICES / 2
    table = spark.createDataFrame([(1, 0, 0, 0, 2, [7, 8], [1, 1], [1, 2, -5, 1], [3, -9], [5, 6], [1, 2, 3, 4])], "dim int, slice int, q int, c int, width int, q_ids array<long>, q_vhs array<long>, q_vs array<long>, q_cut array<long>, c_ids array<long>, c_vs array<long>")
    row = topk.sent(table).first()  # parts: query 7: 5, 11; query 8: -3, -11; shares 2 and -4
    assert (row.n, list(row.places), list(row.parts)) == (3, [0, 1, 2], [5, 11, -3])


def test_topk_copies_of_queries_stay_off_the_driver(spark, monkeypatch):
    """Copies of the queries, one for each block of candidates, are never broadcast, however small the queries are."""
    met = []
    for name in ("local_best", "sent"):
        monkeypatch.setattr(topk, name, lambda pairs, *rest, made=getattr(topk, name): met.append(pairs) or made(pairs, *rest))
    table = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<double>")
    assert topk.top_k(table, F.col("id") % 10 == 0, k=2, candidates=4, queries=2).count() == 12
    for pairs in met:
        pairs.collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
    assert len(met) == 2


def test_topk_shared_ids_and_overflow(spark):
    rows = [(0, [1.0, 2.0]), (0, [-1.0, 0.5]), (3, [2.0, 2.0]), (3, [0.0, 1.0]), (4, [1.0]), (5, [9.0, -9.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(table, F.col("id") == 0, k=3, candidates=2, queries=1).collect()))
    every = sorted((-int(65536 * np.dot(a, b)), j) for i, a in rows for j, b in rows if i == 0 and j != 0 and len(a) == len(b))[:3]
    assert got == [(0, r + 1, j, -s) for r, (s, j) in enumerate(every)]
    huge = spark.createDataFrame([(0, [1e9, 1e9]), (1, [1e9, 1e9])], table.schema)
    with pytest.raises(Exception, match="OverflowError"):
        topk.top_k(huge, F.col("id") == 0).collect()


def test_topk_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, -2.0]), (1, [-3.0, 4.0]), (2, [])], schema)
    assert sorted(map(tuple, topk.top_k(few, F.col("id") == 0, k=5).collect())) == [(0, 1, 1, -11 * 65536)]
    assert topk.top_k(few.limit(0), F.col("id") == 0).count() == 0


# 9 ------------------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values):
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= 4 and top(i) != top(j):
            root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(values))]


def test_position_triples_cover_all_fours():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20 and all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_fingerprints(monkeypatch):
    for text in (None, "", "One", "a b c", "A b\x0bc d", "é " * 9, LONG[:5000], "a\u00a0b c d e f"):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert simhash.fingerprint(LONG[:5000]) == plain_fingerprint(LONG[:5000])


@pytest.mark.parametrize("block", [8192, 20])
def test_links_against_brute_force(spark, block):
    rnd, values = random.Random(8), set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 70)):
            for _ in range(rnd.randint(0, 3)):
                x ^= 1 << rnd.randrange(64)
            values.add(x)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = components.roots(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block)).collect()
    root = dict(zip(signed, signed)) | {r.node: r.root for r in found}
    groups: dict = {}
    for v, k in zip(signed, brute_components(values)):
        groups.setdefault(k, []).append(v)
    assert {v: min(g) for g in groups.values() for v in g} == root


def test_simhash_odd(spark, odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (1, 2, 7)} == {("0" * 16, 1)}
    assert {r.component_id for r in got if r.doc_id in (None, 3)} == {3} and {r.component_id for r in got if r.doc_id in (4, 5)} == {4}
    kept = simhash.keep_one(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 6] and kept.columns == odd.columns
    assert simhash.keep_one(empty).count() == simhash.near_duplicates(empty).count() == 0
    lone = docs(spark, [(None, "no id at all here", None), (None, "other text without one now", None)])
    assert simhash.keep_one(lone).count() == 2 and {r.component_id for r in simhash.near_duplicates(lone).collect()} == {None}


def test_simhash_hot_fingerprints_are_dealt(spark):
    table = docs(spark, [(i, "one text that many rows hold", None) for i in range(50)] + [(100, "some other words stand here", None)])
    want = sorted(map(tuple, simhash.classes(table).collect()))
    assert sorted(map(tuple, simhash.classes(table, broadcast_classes=0, hot_rows=7).collect())) == want and len(want) == 51


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.roots(chain).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def test_components_of_a_hub_are_dealt(spark):
    star = spark.createDataFrame([(9, i) for i in range(10, 90)] + [(90, 9), (3, 90)], "a long, b long")
    got = {r.node: r.root for r in components.roots(star, broadcast_keys=0, hot_rows=7).collect()}
    assert got == {i: 3 for i in range(9, 91)}


# 10 ------------------------------------------------------------------- licence scan


def test_license_scan_against_plain(spark, odd, empty):
    import re

    def pairs(line):
        words = re.sub(r"[\W_]+", " ", line.lower()).strip().split(" ")
        return {(a, b) for a, b in zip(words, words[1:])}

    texts = ["Intro.\nLicensed under CC BY-NC 4.0.\nreleased under THE mit license!!", "Licensed under the Apache License, Version 2.0", None, "", "MIT", "This work is licensed under the GNU General Public License, version 3. " * 3, "licensed under the Apache\nLicense"]
    table = docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(1, texts[1], None)])
    got = sorted((r.doc_id, r.line_no, r.template_id, round(r.score, 9)) for r in license_scan.scan(table, license_scan.default_templates(spark)).collect())
    want = []
    for i, t in [*enumerate(texts), (1, texts[1])]:
        for k, line in enumerate((t or "").split("\n")):
            a = pairs(line)
            scores = [(-2 * len(a & pairs(n)) / (len(a) + len(pairs(n))), name) for name, _, n in license_scan.TEMPLATES if a]
            if scores and -min(scores)[0] >= 0.8:
                want.append((i, k, min(scores)[1], round(-min(scores)[0], 9)))
    assert got == sorted(want) and len(got) == 5
    assert license_scan.scan(odd, license_scan.default_templates(spark)).count() == 0
    assert license_scan.scan(empty, license_scan.default_templates(spark)).count() == 0
    assert license_scan.scan(table, license_scan.default_templates(spark).limit(0)).count() == 0


def test_license_scan_finds_wrapped_and_inline_notices(spark):
    import textwrap

    notice = {t: n for t, _, n in license_scan.TEMPLATES + license_scan.NOTICES}
    comment = lambda t, mark: "\n".join(mark + x for x in textwrap.wrap(notice[t], 78 - len(mark)))
    inline = "This project was written by Ann Smith in 2020 and is released under the MIT License."
    rows = [
        (1, "int a;\n\n" + comment("mit-grant", "") + "\nint b;"),
        (2, inline),
        (3, "/*\n" + comment("gpl-2-header", " * ") + "\n */\nint main"),
        (4, "MIT License\n\n" + comment("mit-full", "# ") + "\nx = 1"),
        (5, comment("bsd-3-full", "// ")),
        (6, comment("apache-2-header", "; ")),
        (7, f"One. {inline} Two is licensed under CC BY 4.0. and more of it, {inline}"),
        (8, "released under\nthe sun, by the MIT press; license it"),
        (9, "released under the MIT license\n" + "words before " * 30 + "is\nlicensed under\nCC BY-SA\n4.0"),
    ]
    table = docs(spark, [(i, t, None) for i, t in rows] + [(2, inline, None), (None, inline, None)])
    for bound in (license_scan.BROADCAST_BIGRAMS, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(license_scan, "BROADCAST_BIGRAMS", bound)
            patch.setattr(license_scan, "BROADCAST_KEYS", bound)
            got = license_scan.scan(table, license_scan.default_templates(spark)).collect()
        found = sorted((r.doc_id or 0, r.line_no, r.template_id) for r in got)
        assert found == [(0, 0, "mit-released"), (1, 2, "mit-grant"), (2, 0, "mit-released"), (2, 0, "mit-released"), (3, 1, "gpl-2-header"), (4, 2, "mit-full"), (5, 0, "bsd-3-full"), (6, 0, "apache-2-header"), (7, 0, "cc-by-4"), (7, 0, "mit-released"), (7, 0, "mit-released"), (9, 0, "mit-released"), (9, 2, "cc-by-sa-4")]
        assert all(r.score == 1.0 for r in got if r.doc_id in (1, 2, 4, 5, 6, 7))
