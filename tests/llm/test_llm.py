"""Training-data operators: edge cases, brute force, round trips and held-out accuracy."""

import html
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from cohortry.llm import (common, decontaminate, html_extract, jaccard_join, language_id, lm, mixing, quality, quality_model, queries,
                          token_files, toxicity)

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
LONG = " ".join(f"w{k % 977}" for k in range(30_000))
DOCS = [
    (1, BASE + " nineteen twenty", "en", "b", 1), (2, BASE + " nineteen twentyone", "en", "b", 1), (2, None, "en", "b", 1),
    (3, BASE.upper() + " NINETEEN TWENTY", None, "a", 1), (4, "", "de", None, 0), (5, None, None, None, None), (6, " \t\n", "de", "a", 3),
    (7, "few words", "de", "a", 1), (8, "Few  Words", "de", "a", 1), (9, LONG, "en", "b", 1), (9, LONG, "en", "b", 1),
    (10, LONG + " more", "en", "c", 1), (None, "no id here at all today", "en", "c", 1), (11, "ünder ß straße x 12 é", "de", "\U0001F600", 1),
    (12, "intro words here " + BASE + " and an end", "en", "￿", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql)


# mixing

def test_mixing_matches_sql_on_real_rows(spark):
    rows = common.table(spark, SF, "documents")
    got = mixing.mix(mixing.sized(rows)).select("doc_id", "size", "source_size", "target", "taken").toPandas().sort_values("doc_id")
    want = duck(queries.SQL["op3_mixing"], documents=rows).df().sort_values("doc_id")
    assert got["taken"].tolist() == want["taken"].tolist() and np.allclose(got["target"], want["target"])


def test_mixing_edges(spark, docs, nothing):
    got = mixing.mix(mixing.sized(docs)).toPandas()
    assert len(got) == len(DOCS)
    assert (got["taken"] <= 2 * got["size"]).all() and (got["taken"][got["size"] == 0] == 0).all()
    per = got.groupby(got["source"].fillna("-")).agg({"taken": "sum", "target": "max"})
    assert (abs(per["taken"] - per["target"]) <= 1).all()
    again = mixing.mix(mixing.sized(docs.repartition(5))).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).fillna(-1).values.tolist() == again[key].sort_values(key).fillna(-1).values.tolist()
    assert mixing.mix(mixing.sized(nothing)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_mixed_documents_keep_clashing_columns(spark, docs):
    clashing = docs.selectExpr("*", "1 as tie", "2 as copies", "3 as slot", "4 as pass", "5 as whole", "6 as id", "7 as _id")
    got = mixing.mixed_documents(clashing)
    assert got.columns == clashing.columns
    assert {tuple(r)[5:] for r in got.collect()} == {(1, 2, 3, 4, 5, 6, 7)}
    plain = mixing.mixed_documents(docs)
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, plain.collect()))


def test_beginnings_of_the_mix_are_near_the_weights(spark):
    rows = [(k, f"w{k} " * 40, None, "abc"[k % 3], 0) for k in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    ordered = mixing.in_schedule_order(docs, block_words=40)
    got = [(r.mix_pass, r.mix_slot, r.source) for r in ordered.collect()]
    assert [g[:2] for g in got] == sorted(g[:2] for g in got)
    assert sorted(r.doc_id for r in ordered.collect()) == sorted(r.doc_id for r in mixing.mixed_documents(docs).collect())
    per = mixing.mix(mixing.sized(docs), block_words=40)
    words = {r.source: r.t for r in per.groupBy("source").agg({"taken": "sum"}).toDF("source", "t").collect()}
    first = [s for p, _, s in got if p == 1]
    weights = {s: n / sum(words.values()) for s, n in words.items()}
    for n in range(20, 200, 20):  # all three sources still have blocks of the first pass
        for source, weight in weights.items():
            assert abs(first[:n].count(source) / n - weight) <= 0.12, (n, source)


def test_schedule_gives_every_source_its_slots(spark):
    slots = mixing.schedule(spark.createDataFrame([(0, 700), (1, 3), (2, 50)], "s long, slots long"))
    counts = {r["s"]: r["count"] for r in slots.groupBy("s").count().collect()}
    assert counts[0] >= 700 and counts[1] >= 3 and counts[2] >= 50
    early = [r["count"] for r in slots.filter("j < 100").groupBy("s").count().orderBy("s").collect()]
    assert early[0] > 60  # no source waits for the end of the schedule


# decontamination

ITEMS = [(1, " ".join(BASE.split()[2:14])), (2, "Few, words!"), (3, None), (4, "..."), (None, "intro words here"), (5, "absent words of an item"),
         (1, " ".join(BASE.split()[2:14]))]


def _contamination_rows(df):
    out = df.toPandas()
    out["items"] = out["item_ids"].map(lambda x: ",".join(x))
    return sorted(out[["doc_id", "n_words", "n_hit", "items"]].fillna(-1).values.tolist(), key=str)


def test_decontamination_against_brute_force(spark, docs, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = _contamination_rows(decontaminate.contamination(docs, items))
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

    def words(t):
        return word.findall((t or "").translate(common.ASCII_LOWER))

    want = []
    for doc_id, text, *_ in DOCS:
        w, hit, found = words(text), set(), set()
        for item, t in ITEMS:
            v = words(t)
            n = min(10, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j: j + n] == v[i: i + n]:
                        hit.update(range(j, j + n))
                        found |= {str(item)} if item is not None else set()
        want.append([-1 if doc_id is None else doc_id, len(w), len(hit), ",".join(sorted(found))])
    assert got == sorted(want, key=str)
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not decontaminate.contamination(docs, items.limit(0)).filter("contaminated").count()
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_decontamination_matches_sql_on_real_rows(spark):
    tables = {n: common.table(spark, SF, n) for n in ("documents", "benchmark")}
    got = queries.QUERIES["op2_decontamination"](spark, SF).toPandas().sort_values("doc_id")
    want = duck(queries.SQL["op2_decontamination"], **tables).df().sort_values("doc_id")
    assert got[want.columns].values.tolist() == want.values.tolist()


# Jaccard join

def _brute(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        w = re.findall("[^ \t-\r]+", (text or "").translate(common.ASCII_LOWER))
        s = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        sets.setdefault(doc_id, []).append(s)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(sets)
    for a in keys:
        for b in keys:
            if any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y, key=lambda v: v if v is not None else 1e18)] = min(x, y, key=lambda v: v if v is not None else 1e18)
    return {d: find(d) for d in keys}


@pytest.mark.parametrize("refine_rows, block", [(2048, 1 << 20), (2, 60)])
def test_jaccard_components_against_brute_force(spark, docs, nothing, monkeypatch, refine_rows, block):
    monkeypatch.setattr(jaccard_join, "REFINE_ROWS", refine_rows)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    words = BASE.split() * 4
    near = [(100 + k, " ".join(words[: k * 2] + ["x"] + words[k * 2 + 1:]), "en", "n", 0) for k in range(30)]
    rows = DOCS + near
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == _brute(rows)
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_one_of_each_keeps_one(spark, docs):
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    ids = Counter(r.doc_id for r in left.collect())
    assert ids[9] == 1 and ids[1] == 1 and 3 not in ids and 8 not in ids and ids[4] == 1 and ids[5] == 1 and ids[10] == 0


def test_jaccard_matches_sql_on_real_rows(spark):
    rows = common.table(spark, SF, "documents")
    want = duck(queries.SQL["op4_jaccard_join"], documents=rows).fetchall()
    assert by_id(jaccard_join.jaccard_components(rows), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)


def test_ids_with_different_texts_link_by_each(spark):
    one, two = ([f"{p}{k}" for k in range(40)] for p in "xy")
    text = lambda words, *more: " ".join([*words, *more])
    rows = [(1, text(one)), (1, text(two)), (2, text(one, "a")), (3, text(two, "b")), (4, text(one, "c")), (5, text(two, "d")),
            (1, ""), (1, None), (6, "alone here"), (7, text(two, "b")), (6, text(one[::-1])), (6, ""), (8, ""), (None, text(two))]
    want = sorted(((d, _brute(rows)[d]) for d, _ in rows if d is not None), key=str)
    for order in (rows, rows[::-1], rows[5:] + rows[:5]):
        docs = spark.createDataFrame([(d, t, "x") for d, t in order], "doc_id long, text string, name string").repartition(3)
        found = jaccard_join.jaccard_components(docs).filter("doc_id is not null")
        assert by_id(found, "doc_id", "component_id") == want
        kept = jaccard_join.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.filter("doc_id is not null and text <> ''").collect()) == [1, 6]
        assert len({str(jaccard_join.one_of_each(d).filter("doc_id = 6 and text <> ''").collect()) for d in (docs, docs.repartition(5))}) == 1


# token files

def test_tokens_round_trip(spark, docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    got = token_files.token_files(docs, queries.tokenizer_path(), block_tokens=50).orderBy("start").collect()
    texts = {}
    for doc_id, text, *_ in DOCS:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        texts.setdefault(doc_id, set()).add((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in texts[r.doc_id]
        at += r.n_tokens
    ids = [r.doc_id for r in got]
    assert len(got) == len(DOCS) and ids[0] is None and ids[1:] == sorted(ids[1:])
    assert token_files.token_files(nothing, queries.tokenizer_path()).count() == 0


def test_encoder_equals_tokenizer_on_odd_texts():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(queries.tokenizer_path()), token_files.Encoder(queries.tokenizer_path())
    odd = ["", "  a  b ", "\n\n x", "\n x", "a\nb,c", "it's 5,000 don't", "\x1c!\x1c a", "<|endoftext|> a", "é  x  ", "日本 語。a1b2",
           "a.b ...\t\n!", "A|B $x %% ## ** && ;:", "\r\n ab", " a  b", "á b"]
    for x, got in zip(odd, encoder.encode(odd)):
        assert got[:-1].tolist() == tokenizer.encode(x, add_special_tokens=False).ids


def test_encoder_equals_tokenizer_on_real_texts_with_a_small_cache(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "_CACHE", 500)
    tokenizer, encoder = Tokenizer.from_file(queries.tokenizer_path()), token_files.Encoder(queries.tokenizer_path())
    assert encoder.apart
    texts = [r.text or "" for r in common.table(spark, SF, "documents").select("text").collect()]
    texts += ["Word", "foo Bar", "Baz.\nqux, and\n\nmore", "\nline", "x\n y", "a" * 3000 + " end", "\u0250\u01c2 \u0249!"]
    for lo in range(0, len(texts), 16):
        some = texts[lo: lo + 16]
        want = [[*x.ids, 0] for x in tokenizer.encode_batch(some, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(some)] == want


def test_vocabulary_check_finds_tokens_over_an_end():
    letters = token_files._byte_letters()
    space, line = chr(letters[32]), chr(letters[10])
    assert token_files._keeps_apart(iter([space + "word", "...", line * 2, "\xc2\xae,"]), letters)
    for token in ("a" + space + "b", "." + space, "a" + line, line + "a", line + space, "a,"):
        assert not token_files._keeps_apart(iter([token]), letters)


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [1, 2, 3, 1000, 70_000], list(range(0, 5000, 3))])
def test_elias_fano(values):
    ef = token_files.EliasFano.build(np.array(values, np.int64))
    assert ef.decode().tolist() == values
    assert [ef.select(i) for i in range(len(values))] == values


# quality

def test_base_rules_against_brute_force(spark, docs, nothing):
    target, raw = quality.bucket_counts(docs, spark.createDataFrame([(1,), (9,)], "doc_id long"), 256)
    assert raw.sum() > target.sum() > 0
    rows = quality.assess(docs, quality.log_ratios(target, raw)).collect()
    assert len(rows) == len(DOCS)
    for text in [d[1] for d in DOCS] + ["a b c a b c a b c x\na b\na b\n\n\n# $"]:
        words = re.findall("[^ \t-\r]+", text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i: i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
        n, chars, symbols, dup, repeat, failed = quality.base_rules(text, common.words_of(text))
        assert (n, chars, repeat) == (len(words), sum(map(len, words)), len(hit))
        assert dup == sum(x in lines[:k] for k, x in enumerate(lines)) and symbols == len(re.findall(r"[#*$%&|<>]", text or ""))
        assert failed == (n < 50 or 100 * repeat > 50 * n)
    assert quality.assess(nothing, np.zeros(16)).count() == 0
    assert not quality.log_ratios(np.zeros(4), np.ones(4)).any()


# quality classifier

def test_quality_classifier(spark, docs, nothing):
    rows = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == rows.count()
    marks = common.table(spark, "/root/testdata/sf0.01", "labels").toPandas().merge(got, on="doc_id")
    assert marks[marks.quality == 1].kept.mean() > 0.95
    assert marks[marks.quality == 1].score.mean() > marks[marks.quality == 0].score.mean() + 0.2
    fitted = quality_model.estimate(quality_model.pattern_counts(nothing))
    weights = quality_model.train(nothing, *fitted)
    assert quality_model.classify(docs, *fitted, weights).count() == len(DOCS)
    assert quality_model.classify(nothing, *fitted, weights).count() == 0


def test_hash_share_never_rounds_to_nothing(spark):
    """The share of a table of 10^10 rows and more still picks its rows; shares are nested; small tables are whole."""
    from pyspark.sql import functions as F

    ids = spark.range(4_000_000)
    wanted, sizes = 20_000, (10_000, 2 * 10**4, 10**8, 10**10, 10**11)
    row = ids.agg(*[F.count_if(common.hash_share(F.col("id"), wanted, n)).alias(f"n{i}") for i, n in enumerate(sizes)],
                  F.count_if(common.hash_share(F.col("id"), wanted, 10**11) & ~common.hash_share(F.col("id"), wanted, 10**10))
                  .alias("outside")).first()
    assert row["n0"] == row["n1"] == 4_000_000 and row["outside"] == 0
    for i, n in enumerate(sizes[2:], 2):
        expected = 4_000_000 * wanted / n
        assert abs(row[f"n{i}"] - expected) <= 5 * math.sqrt(expected) + 1
    assert row["n3"] > 0  # below one step of the remainder: 8 rows of 4 million
    with pytest.raises(ValueError, match="empty"):
        common.sampled([], 5)
    assert common.sampled([], 0) == []


def test_quality_sample_has_each_text_once(spark):
    docs = common.table(spark, SF, "documents").limit(60).select("text").distinct().localCheckpoint()
    one = docs.filter("text IS NOT NULL").orderBy("text").limit(1)
    copies = docs.unionAll(one.selectExpr("explode(array_repeat(text, 500)) text")).unionAll(spark.range(300).selectExpr("cast(null as string) text"))
    fitted = quality_model.estimate(quality_model.pattern_counts(docs))
    assert (quality_model.train(copies, *fitted) == quality_model.train(docs, *fitted)).all()


def test_em_finds_the_good_labeller():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.7
    right = np.linspace(0.95, 0.6, len(quality_model.BOUNDS))
    cast = np.where(rng.random((4000, len(right))) < right, truth[:, None], ~truth[:, None]).astype(int)
    table, good = quality_model.estimate(Counter(quality_model.pattern_of(list(map(int, c))) for c in cast))
    assert abs(good - 0.7) < 0.05 and np.all(np.abs(table[:, 1, 1] - right) < 0.06)


# language

def test_language_edges_and_accuracy(spark, docs, nothing):
    assert language_id.learn(nothing) == {} and language_id.identify(docs, {}).filter("lang_pred <> 'und'").count() == 0
    rows = common.table(spark, "/root/testdata/sf0.01", "documents")
    content = language_id.learn(rows)
    out = language_id.identify(docs.withColumn("lang_pred", docs.source), content)
    found = {r.doc_id: r.lang_pred for r in out.collect()}
    assert out.count() == len(DOCS) and found[4] == found[5] == found[6] == "und" and found[7] in content
    held = rows.filter(common.id_remainder(rows.doc_id, 4) == 2)
    marks = [r.lang == r.lang_pred for r in language_id.identify(held, content).collect()]
    assert np.mean(marks) > 0.9


# toxicity

def test_toxicity_edges_and_held_out(spark, docs, nothing):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_toxicity"](spark, sf).join(common.table(spark, sf, "labels"), "doc_id").filter("held_out").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert bad.score.mean() > 0.5 and (good.predicted == 1).mean() < 0.05
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (2, 1, 1), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled(docs, labels))
    out = toxicity.score(docs, model).collect()
    assert len(out) == len(DOCS) and all(0 <= r.score <= 1 for r in out)
    empty = toxicity.fit(toxicity.labelled(nothing, labels))
    assert toxicity.score(docs, empty).count() == len(DOCS)


def test_isotonic_is_monotone():
    knots, rates = toxicity.isotonic(np.array([1.0, 2, 2, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(rates) >= 0).all() and (np.diff(knots) >= 0).all()


# pages

def test_pages(spark):
    pages = common.table(spark, "/root/testdata/sf0.01", "pages")
    model = html_extract.train(pages)
    for r, text in zip(rows := pages.limit(60).collect(), html_extract.main_texts(model, [r.html for r in rows])):
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert text == "\n".join(x for x in parts if x)
    page = ('<body><header>Top</header><div class="cookie-notice"><p>We use cookies, accept all of them.</p></div><div class="content"><h1>T &amp; m</h1>'
            '<p>First <b>bold</b> one.<p>Second&nbsp;one.</div><section id="comments"><p>I like this a lot, thank you for it.</p></section>'
            "<form>Mail</form><script>var a='<p>';</script><footer>f</footer>")
    assert html_extract.main_texts(model, [page, None, ""]) == ["T & m\nFirst bold one.\nSecond one.", "", ""]
    odd = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p")], "page_id long, url string, html string")
    assert [r.n_chars for r in html_extract.extract(odd, model).collect()][:2] == [0, 0]
    assert html_extract.extract(odd.limit(0), html_extract.train(odd.limit(0))).count() == 0


def test_wrappers_and_open_heads_keep_the_article(spark):
    model = html_extract.train(common.table(spark, "/root/testdata/sf0.01", "pages"))
    first = "The council met on Monday evening and agreed on the plan for the new bridge over the river, after a long debate."
    second = "Work begins in spring, said the mayor, and the old crossing stays open to people on foot until the end of the year."
    paragraphs = f"<p>{first}</p><p>{second}</p>"
    outside = ('<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>', '<footer><p>Imprint and privacy.</p></footer>')
    article = f"{outside[0]}<article><h1>A new bridge</h1>{paragraphs}</article>{outside[1]}"
    want = f"A new bridge\n{first}\n{second}"
    pages = [
        article, f'<body class="has-sidebar">{article}</body>', f'<html class="no-ads"><body class="sidebar">{article}</body></html>',
        f'<body><div class="layout-with-sidebar">{article}</div></body>', f'<body><div class="sidebar layout">{article}</div></body>',
        f'<body><div id="header-and-content">{article}</div></body>', f"<body><form action='/p'>{article}</form></body>",
        f'<body>{outside[0]}<article><header class="entry-header"><h1>A new bridge</h1></header>{paragraphs}</article>{outside[1]}</body>',
        f'<body><form><div class="content"><h1>A new bridge</h1>{paragraphs}</div></form></body>',
        f'<html><head><title>T</title><meta charset="utf-8"><link rel="x" href="y">{article}</html>',
        f"<head><title>T</title><div>{article}</div>",
    ]
    assert html_extract.main_texts(model, pages) == [want] * len(pages)
    bare = f"<head><title>T</title><p>{first}<p>{second}"
    assert html_extract.main_texts(model, [bare]) == [f"{first}\n{second}"]
    comments = f'<section class="comments"><article><p>{second}</p></article></section>'
    ad = '<div class="ad"><p>Buy this great thing today.</p></div>'
    mixed = f'<body class="has-comments"><article><h1>A new bridge</h1><p>{first}</p>{ad}<p>{second}</p></article>{comments}</body>'
    assert html_extract.main_texts(model, [mixed]) == [want]


# language model

def test_lm_base_scores_against_brute_force(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(lm, "HEAD_WORDS", 40)
    monkeypatch.setattr(lm, "STEPS", 10)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    fitted = lm.fit(lm.training(docs), path, pattern)
    got = lm.score(docs, *fitted).collect()
    texts = [re.findall("[^ \t-\r]+", (d[1] or "").translate(common.ASCII_LOWER)) + [""] for d in DOCS]
    counts = Counter(w for d, t in zip(DOCS, texts) if common.id_remainder_py(d[0], 7) != 2 for w in t)
    total = sum(counts.values())
    want = sorted((-1 if d[0] is None else d[0], len(t), sum(counts[w] > 0 for w in t),
                   round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in t), 4)) for d, t in zip(DOCS, texts))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert lm.score(docs, *lm.fit(nothing, path, pattern)).count() == len(DOCS)


def test_lm_score_is_the_same_however_many_words_travel_with_the_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = []
    for most in (3, 100_000):
        monkeypatch.setattr(lm, "HEAD_WORDS", most)
        rows = lm.score(docs, *lm.fit(lm.training(docs), path, pattern)).collect()
        found.append(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4),
                             round(r.score, 4)) for r in rows))
    assert found[0] == found[1]


def test_words_encoded_together_equal_words_encoded_apart():
    subwords = lm.Subwords(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = ["plain", "don't", "'s", "a\ud800b", "5,000", "...", "日本", "x" * 500, "é"]
    for words in ([], plain, plain + ["a\xa0", "\x85", "b\u2003c"]):
        ids, size = subwords.many(words)
        want = [subwords(w) for w in words]
        assert ids.tolist() == [k for w in want for k in w] and size.tolist() == [len(w) for w in want]


def test_attention_is_causal_and_scores_each_position_once():
    net = lm.Attention(np.zeros(lm.CLASSES))
    rng = np.random.default_rng(0)
    flat, lengths = rng.integers(1, lm.CLASSES, 100), np.array([100])
    text, first = lm.windows(lengths)
    inputs, real, target, scored = lm.gather(flat, np.array([0]), lengths, text, first)
    assert scored.sum() == 100
    before = net.log_probs(inputs, real, target)
    changed = flat.copy()
    changed[60:] = 1
    inputs, real, _, _ = lm.gather(changed, np.array([0]), lengths, text, first)
    after = net.log_probs(inputs, real, target)
    assert np.allclose(before[scored][:60], after[scored][:60], atol=1e-5)
    assert np.allclose(np.exp(np.stack([net.log_probs(inputs, real, np.full_like(target, k)) for k in range(lm.CLASSES)])).sum(0), 1, atol=1e-4)


# pipeline

def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "mixing", "token_files"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, kept, SF), name)
        assert kept.columns == docs.columns and kept.count() > 0
    out = corpus_pipeline.run(spark, SF)
    assert by_id(out, "doc_id") == by_id(kept, "doc_id")
