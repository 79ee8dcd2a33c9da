"""Archives, divergence and alignment against brute force on small inputs."""

import bisect
import gzip
import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from cohortry.llm import align, archives, divergence

# ------------------------------------------------------------------ archives


def arc_file(version, *records):
    """``records``: header line and content."""
    return archives.version_block("old.arc", version) + b"".join(b"\n" + h + b"\n" + c for h, c in records)


def test_arc_version_1_is_cut_by_declared_lengths():
    body = b"HTTP/1.0 200 OK\r\n\r\nhttp://trap/ 1.1.1.1 20010101000000 text/html 3\nabc"
    raw = arc_file(1, (b"http://a/b c?x=1 9.9.9.9 200102030405 text/html; charset=x %d" % len(body), body),
                   (b"dns:a.org 9.9.9.9 20011399000000 text/dns 4", b"\xff\xfe\x00\n"))
    head, page, dns = archives.arc_records(raw)
    assert head["url"] == "filedesc://old.arc" and head["version"] == 1
    assert (page["url"], page["type"], page["content"]) == ("http://a/b c?x=1", "text/html; charset=x", body)
    assert archives.iso_date(page["date"], "") == "2001-02-03T04:05:00Z"
    assert dns["content"] == b"\xff\xfe\x00\n" and archives.iso_date(dns["date"], dns["archive_date"]) == "2000-01-01T00:00:00Z"
    assert raw[page["offset"]:].startswith(b"http://a/b c")


def test_arc_version_2_and_gzip_members_agree():
    raw = arc_file(2, (b"http://a/ 9.9.9.9 20010203040506 text/html 404 - http://b/ 17 old.arc 2", b"hi"))
    cut = raw.index(b"http://a/")
    for content in (raw, gzip.compress(raw), gzip.compress(raw[:cut]) + gzip.compress(raw[cut:])):
        _, page = archives.arc_records(content)
        assert (page["result"], page["location"], page["content"], page["offset"]) == ("404", "http://b/", b"hi", cut)


@pytest.mark.parametrize("raw", [
    b"http://a/ 9.9.9.9 20010203040506 text/html 2\nhi",
    arc_file(1, (b"http://a/ 9.9.9.9 20010203040506 text/html 9", b"short")),
    arc_file(1, (b"no header", b"")),
    archives.version_block("x", 1).replace(b"1 0 cohortry", b"7 0 cohortry"),
])
def test_malformed_arc_is_an_error(raw):
    with pytest.raises(ValueError):
        list(archives.arc_records(raw))
    assert list(archives.arc_records(b"")) == []


def test_foreign_arc_becomes_warc(spark, tmp_path):
    """Bytes that are no text, a record without an HTTP head, a record without a page id."""
    (tmp_path / "arc").mkdir()
    body = b"HTTP/1.1 200 OK\r\nX-A: b\r\n\r\n\x00\xff\xfe"
    raw = arc_file(1, (b"http://a/ 9.9.9.9 20010203040506 text/html %d" % len(body), body),
                   (b"http://a/ 9.9.9.9 20010203040507 text/html %d" % len(body), body),
                   (b"dns:a 9.9.9.9 20010203040506 text/dns 2", b"\xff\n"))
    (tmp_path / "arc" / "one.arc.gz").write_bytes(gzip.compress(raw))
    archives.convert(spark, str(tmp_path / "arc"), str(tmp_path / "warc"))
    kinds = Counter(r["record_type"] for r in archives.read_warc(spark, str(tmp_path / "warc")).collect())
    assert kinds == {"warcinfo": 1, "response": 1, "revisit": 1, "resource": 1}
    records = [r for f in (tmp_path / "warc").glob("part*") for r in archives.warc_records(f.read_bytes())]
    blocks = {f["warc-type"]: b for f, b in records}
    assert blocks["response"] == body and blocks["revisit"] == body[:-3] and blocks["resource"] == b"\xff\n"
    fields = {f["warc-type"]: f for f, _ in records}
    assert fields["revisit"]["warc-refers-to"] == fields["response"]["warc-record-id"]
    assert fields["revisit"]["warc-payload-digest"] == "sha1:" + archives.sha1_base32(b"\x00\xff\xfe")
    assert len({f["warc-record-id"] for f, _ in records}) == 4


def expected_pages(rows):
    head = {}
    for page_id, html in rows:
        head[html or ""] = max(head.get(html or "", -1), page_id)
    return sorted((p, len((h or "").encode()), archives.sha1_base32((h or "").encode()),
                   "response" if head[h or ""] == p else "revisit", None if head[h or ""] == p else head[h or ""]) for p, h in rows)


@pytest.mark.parametrize("hot", [False, True])
def test_pages_come_back_whole(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(archives, "HOT_SHARE", 3)
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, "é\r\n\r\nWARC/1.1\r\nx"), (6, "a" * 300_000), (7, "a"), (8, "b"), (9, "a")]
    frame = spark.createDataFrame([(p, "http://x/ y\n" if p % 2 else None, h, "clash", 0) for p, h in rows],
                                  "page_id long, url string, html string, payload_digest string, record_id int")
    out = archives.archived(frame.repartition(3)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, out.collect())) == expected_pages(rows)


def test_repeated_and_null_page_ids_and_no_pages(spark):
    schema = "page_id long, url string, html string"
    frame = spark.createDataFrame([(1, "u", "a"), (1, "u", "a"), (None, "u", "a"), (None, "u", "z")], schema)
    found = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in archives.archived(frame).collect())
    assert found == {(1, "response", None): 1, (1, "revisit", 1): 1, (None, "revisit", 1): 1, (None, "response", None): 1}
    assert archives.archived(spark.createDataFrame([], schema)).count() == 0


def test_small_payloads_stay_responses(spark):
    frame = spark.createDataFrame([(1, "u", "a"), (2, "u", "a"), (3, "u", "bb"), (4, "u", "bb")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in archives.archived(frame, min_payload=2).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


# ------------------------------------------------------------------ divergence


def brute_divergence(rows, min_docs, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    rows = [(lang or "", source or "", Counter(term.findall((text or "").translate(lower)))) for text, lang, source in rows]
    docs, by_lang, by_group, members = Counter(), Counter(), Counter(), defaultdict(set)
    for lang, source, found in rows:
        members[lang].add(source)
        for t, n in found.items():
            docs[lang, t] += 1
            by_lang[lang, t] += n
            by_group[lang, source, t] += n
    out = []
    for lang, sources in members.items():
        kept = [t for (g, t), n in docs.items() if g == lang and n >= min_docs]

        def shares(count):
            total = sum(map(count, kept))
            return {t: 1 + 10**9 * (count(t) + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(lambda t: by_lang[lang, t])
        p = {s: shares(lambda t: by_group[lang, s, t]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if by_group[lang, s, t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, i.decode(), -v, k + 1) for k, (v, i) in enumerate(sorted(found)[:limit])]
    return sorted(out)


def divergence_rows():
    rng = random.Random(5)
    words = ["The", "the", "über", "ÜBER", "x" * 50, "x" * 49 + "y", "語" * 30, "ab", "abc", "abcdef", "abcdefg", "a"]
    words += [f"{'rare' * rng.randint(1, 9)}{chr(97 + k % 26)}" for k in range(60)]
    rows = []
    for _ in range(160):
        text = rng.choice([" ", "1", "-\n"]).join(rng.choices(words, weights=[9] * 12 + [1] * 60, k=rng.randint(0, 40)))
        rows.append((text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", None])))
    return rows + [(None, "en", "s1"), ("", "fr", "only"), ("Lone", "fr", None), ("the " * 3000, "en", "s2")] + rows[:20]


@pytest.mark.parametrize("bits", [None, 64])
def test_divergence_equals_brute_force(spark, monkeypatch, bits):
    if bits:  # a bitmap full of collisions only passes more prefixes on
        monkeypatch.setattr(divergence, "MIN_BITS", bits)
        monkeypatch.setattr(divergence, "MAX_BITS", bits)
    monkeypatch.setattr(divergence, "_HELD_BYTES", 500)
    rows = divergence_rows()
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "text string, lang string, source string, n long, terms string")
    out = divergence.divergence(docs.repartition(3), min_docs=8, top=7)
    assert sorted(map(tuple, out.collect())) == brute_divergence(rows, 8, 7)


def test_divergence_of_nothing(spark):
    schema = "text string, lang string, source string"
    assert divergence.divergence(spark.createDataFrame([], schema)).count() == 0
    rows = [("a b", "en", "s"), (None, "en", "t"), (None, None, None)]
    assert sorted(map(tuple, divergence.divergence(spark.createDataFrame(rows, schema)).collect())) == [
        ("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


def level(rows, length, before, bitmap):
    batch = pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("text", pa.binary())]))
    held = bitmap and type("Held", (), {"value": bitmap})
    return sorted(tuple(r.values()) for b in divergence._level_rows(iter([batch]), length, before, held) for r in b.to_pylist())


def test_refinement_drops_what_did_not_pass():
    rows = [{"lang": "en", "text": b"abcd ZZZZ abce"}, {"lang": "en", "text": b"ab"}, {"lang": "de", "text": b"Abcd"}]
    assert level(rows, 3, 0, None) == [("de", b"abc", 1), ("en", b"ab\0", 1), ("en", b"abc", 1), ("en", b"zzz", 1)]
    bitmap = bytearray(1 << 13)
    place = int(divergence._places("en", [b"abc"], 1 << 16)[0])
    bitmap[place >> 3] |= 1 << (place & 7)
    assert level(rows, 6, 3, bytes(bitmap)) == [("en", b"abcd\0", 1), ("en", b"abce\0", 1)]


def test_terms_of_equal_the_pattern():
    texts = ["", "Ab-cD", "über", "", "x", "1", "a b", "語A", "Z"]
    column = pa.array([t.encode() for t in ["cut", *texts]], pa.binary()).slice(1)
    row, term, terms = divergence.terms_of(column)
    found = [(r, terms[t].as_py().decode()) for r, t in zip(row.tolist(), term.tolist())]
    assert found == [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.lower())]
    _, term, terms = divergence.terms_of(column, 4)
    assert [terms[t].as_py() for t in term.tolist()] == ["über".encode(), "語a".encode()]
    assert not len(divergence.terms_of(pa.array([], pa.binary()))[0]) and not len(divergence.terms_of(pa.array([b""], pa.binary()))[0])


# ------------------------------------------------------------------ alignment


def test_gallop_and_common_ends_equal_sets():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(1, 80), rng.randint(0, 60))) for _ in range(2))
        for start in (0, len(a) // 2):
            x = rng.randint(0, 85)
            assert align.gallop(a, x, start) == max(start, bisect.bisect_left(a, x))
        assert align.common_ends(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]


def test_overlaps_equal_pairs():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 60)
        a, b = (sorted({n, *rng.sample(range(1, n + 1), rng.randint(0, n))}) for _ in range(2))
        spans = [list(zip([0, *x], x)) for x in (a, b)]
        expected = [[j for j, (s, e) in enumerate(spans[1]) if s < hi and lo < e] for lo, hi in spans[0]]
        assert [list(r) for r in align.overlaps(a, b)] == expected


ODD = ["a  b", " a", "a\nb c", "a\n b", "a \n b", "a\r\n  b  ", "x  ", "a ", " ", "  ", "<s> <|endoftext|> x", "▁ a", "a  b",
       "é ﬁ", "a\x00 b c", "\n", "\t a\t b  c", "日本語 テキスト 漢字", "don't  stop's  ' s", "a　b c", "  \n  x", "<0x41>", "͸ x", "Ａ"]


def brute_alignment(texts):
    """Whole texts, without segments."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes, b_bytes = align.byte_level_bytes(tokenizer), align.piece_bytes(pieces)
    found = []
    for x in texts:
        a, b = tokenizer.encode(" " + (x or ""), add_special_tokens=False).ids, pieces.encode(x or "")
        ta, tb = [a_bytes[k] for k in a], [b_bytes[k] for k in b]
        if not x or not b"".join(ta) == b"".join(tb) == (" " + x).encode():
            found.append((0, 0, "", []))
            continue
        ea, eb = (list(itertools.accumulate(map(len, t))) for t in (ta, tb))
        common = sorted(set(ea) & set(eb))
        at = [(ea.index(c) + 1, eb.index(c) + 1) for c in common]
        shown = ";".join(",".join(map(str, a[i0:i1])) + "|" + ",".join(map(str, b[j0:j1]))
                         for (i0, j0), (i1, j1) in zip([(0, 0), *at], at))
        found.append((len(a), len(b), hashlib.sha256(shown.encode()).hexdigest(), [(a[i - 1], b[j - 1]) for i, j in at]))
    counts = Counter(pair for f in found for pair in f[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(na, nb, len(links), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), digest)
            for na, nb, digest, links in found]


@pytest.mark.parametrize("cache", [None, 3])
def test_alignment_equals_whole_texts(spark, monkeypatch, cache):
    if cache:
        monkeypatch.setattr(align, "_CACHE", cache)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    texts += [None, "", *ODD, "longword" * 3000, *ODD[:3]]
    rows = [(k // 2, t, k, "c") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_a int, links string").coalesce(2)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = [tuple(r) for r in align.alignment(docs, *paths).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(out) == sorted((k // 2, *e) for k, e in enumerate(brute_alignment(texts)))


def test_alignment_of_nothing(spark):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert align.alignment(spark.createDataFrame([], "doc_id long, text string"), *paths).count() == 0
    null = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in align.alignment(null, *paths).collect()] == [(None, 0, 0, 0, 0, 0, 0, "")]


def test_links_are_suffixes(spark):
    """The bound on link counts: of two tokens that end together one ends the other."""
    aligner = align.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    for *_, codes in aligner.align(["Some words, and 12,345 more; über-lange Wörter."]):
        for code in codes.tolist():
            x, y = aligner.a_bytes[code // align.B_IDS], aligner.b_bytes[code % align.B_IDS]
            assert x.endswith(y) or y.endswith(x)
