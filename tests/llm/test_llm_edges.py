"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest

LONG = "lorem ipsum dolor sit amet " * 40_000
CLASH = {"score": 1.0, "kept": "x", "size": 3, "key": "k", "node": 1, "label": 0, "rid": 5, "host": "h", "words": "w", "target": 2.0, "path": "p", "start": 1, "value": "v", "lines": "l", "y": 1, "x": 2}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in CLASH.items())
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "a"),
    (4, " \t\n\x0b\x0c\r", "en", "b"),
    (5, "one", None, "b"),
    (5, "one", None, "b"),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", None),
    (None, None, None, None),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", ""),
    (7, LONG, "en", "a"),
    (8, "x" * 200_000, "en", "a"),
    (9, "Ünïcödé ☃ 😀 text\x00with NUL and   odd spaces", "de", "c"),
    (7, "other text of a repeated id", "en", "a"),
    (-3, "negative id " * 30, "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, len(r[1] or ""), *CLASH.values()) for r in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


LABELS = "doc_id long, quality int, toxic int, text string"


def test_near_dedup(spark, docs, none):
    from tidelog.llm.near_dedup import keep_one, near_duplicates

    rows = near_duplicates(docs, width=4).collect()
    assert len(rows) == len(ROWS)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["n_shingles"], r["component_id"], r["kept"]) for r in rows if r["doc_id"] not in (7, 8, 9))
    assert got == [(-99, 0, None, True), (-99, 12, None, True), (-3, 2, -3, True), (1, 12, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 12, 1, False)]
    kept = keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 1
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_quality(spark, docs, none):
    from tidelog.llm.quality import classified

    empty = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in classified(docs, empty).collect()] == [0.5] * len(ROWS)
    labels = spark.createDataFrame([(1, 1, 0, "t"), (5, 0, 1, None), (6, 1, 0, None), (8, 0, 0, None), (9, 1, 1, None), (None, 1, 1, None), (99, 1, 1, None), (3, None, None, None), (1, 0, 0, None)], LABELS)
    rows = classified(docs, labels, modulus=1, remainder=5).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] is False for r in rows)
    assert classified(none, labels).count() == 0


def test_toxicity(spark, docs, none):
    from tidelog.llm.toxicity import scored

    empty = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in scored(docs, empty).collect()] == [0.5] * len(ROWS)
    labels = spark.createDataFrame([(1, 1, 0, "t"), (5, 0, 1, None), (6, 1, 0, None), (8, 0, 0, None), (9, 1, 1, None), (None, 1, 1, None), (2, 1, 1, None), (3, None, None, None), (1, 0, 0, None)], LABELS)
    rows = scored(docs, labels, modulus=1, remainder=5).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert scored(none, labels).count() == 0


def test_url_rules(spark):
    from tidelog.llm.url_rules import judge

    schema = "page_id long, url string, html string, host string, rule string, verdict string"
    urls = ["http://A.COM/x?y", None, "", "no scheme.com/", "https://example.com/en/x", "https://WWW.Example.com/en/", "http://x.net/es/1#t", "http://net/es/", "http://badnet/es/", "http://cheap-pills.org", "http://x.org?q=://y.com/", "http://spam-farm.example.com/en/", "http://a.com", "http://spam-farm.com/", "://"] + ["http://a.com/" + "p" * 100_000]
    pages = spark.createDataFrame([(i, u, None, "h", "r", "v") for i, u in enumerate(urls)] + [(None, "http://a.net/fr/", None, None, None, None)], schema)
    got = {r["page_id"]: (r["host"], r["path"][:20], r["rule"], r["verdict"]) for r in judge(pages).collect()}
    assert got[0] == ("a.com", "/x", "com/", "allow") and got[1] == got[2] == got[3] == got[14] == ("", "", None, "allow")
    assert got[4][2:] == ("example.com/en/", "block") and got[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow") and got[6][2:] == got[7][2:] == ("net/es/", "block")
    assert got[8][2:] == (None, "allow") and got[9][2:] == (None, "block") and got[10] == ("x.org", "", None, "allow") and got[11][3] == "block"
    assert got[12] == ("a.com", "", None, "allow") and got[13][2:] == ("com/", "allow") and got[None][2:] == ("net/fr/", "block")
    assert judge(spark.createDataFrame([], schema)).count() == 0


def test_line_rules(spark, docs, none):
    from tidelog.llm.line_rules import judged, keep_good

    rows = judged(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (None, 7)}
    assert by[1]["kept"] and not by[1]["base_failed"] and (by[1]["n_words"], by[1]["word_chars"]) == (15, 59)
    assert all(by[k]["n_words"] == 0 and by[k]["base_failed"] and not by[k]["kept"] for k in (2, 3, 4))
    assert (by[-3]["n_words"], by[-3]["n_repeat_words"], by[-3]["kept"]) == (60, 60, False)
    long = max((r for r in rows if r["doc_id"] == 7), key=lambda r: r["n_words"])
    assert long["n_words"] == long["n_repeat_words"] == 200_000
    kept = keep_good(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == {1, 6, None}
    assert judged(none).count() == 0 and keep_good(none).count() == 0


def test_decontaminate(spark, docs, none):
    from tidelog.llm.decontaminate import keep_clean, leaks

    bench = "item_id long, text string, kept string"
    items = spark.createDataFrame([(1, "quick BROWN fox jumps over the lazy dog  near the old", "k"), (2, None, None), (3, "", None), (4, "tiny", None), (None, "negative id negative id", None), (5, "quick brown fox jumps over the lazy dog near the old", None)], bench)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -99, r["item_id"]) for r in leaks(docs, items).collect())
    assert got == [(-99, 1), (-99, 5), (1, 1), (1, 5), (6, 1), (6, 5)]
    clean = keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ROWS) - 3
    nothing = spark.createDataFrame([], bench)
    assert leaks(docs, nothing).count() == 0 and keep_clean(docs, nothing).count() == len(ROWS) and leaks(none, items).count() == 0


def test_warc(spark):
    from tidelog.llm.warc import derivatives, responses

    schema = "page_id long, url string, html string, record string, content string"
    pages = spark.createDataFrame([(1, "http://a/", "<title>T</title><p>x &amp; y", "r", "c"), (2, None, None, None, None), (1, "http://a/", "<title>T</title><p>x &amp; y", None, None), (None, "u", "", None, None), (3, "http://l/", "<p>" + LONG, None, None)], schema)
    rows = derivatives(responses(pages)).collect()
    assert len(rows) == 10 and len({r["record_id"] for r in rows if r["page_id"] == 1}) == 2
    text = {r["page_id"]: r["content"] for r in rows if r["warc_type"] == "conversion"}
    assert text[1] == "x & y" and text[2] == text[None] == "" and len(text[3]) == len(LONG.strip())
    assert responses(spark.createDataFrame([], schema)).count() == 0
    assert derivatives(spark.createDataFrame([(1, None), (2, bytearray(b"junk"))], "page_id long, record binary")).count() == 0


def test_token_files(spark, docs, none):
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tidelog.llm.token_files import token_digest, tokenizer_path

    tokenizer = Tokenizer.from_file(tokenizer_path())
    rows = sorted(token_digest(docs, tokenizer_path()).collect(), key=lambda r: r["start"])
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [r[0] for r in order]
    at = 0
    for r, o in zip(rows, order, strict=True):
        ids = np.array([*tokenizer.encode(o[1] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_digest(none, tokenizer_path()).count() == 0


def test_html(spark):
    from tidelog.llm.html_text import extract

    schema = "page_id long, url string, html string, text string, n_chars long"
    body = "<html><body><nav><ul><li><a href='/a'>Menu</a></li></ul></nav><article><h1>A  &lt;B&gt;</h1><p>First line<br>second\n line.<p>Unclosed <b>bold</article><div class='comments'><p>Nice post</p></div><footer>Legal</footer>"
    pages = spark.createDataFrame([(1, "u", body, "t", 9), (2, None, None, None, None), (3, "u", "", None, None), (4, "u", "<<<>>> & &#0; <p", None, None), (1, "u", body, None, None), (None, "u", "<article><p>" + LONG + "</article>", None, None), (5, "u", "<div>" * 30_000 + "deep", None, None)], schema)
    rows = extract(pages).collect()
    assert len(rows) == 7 and all(r["n_chars"] == len(r["text"]) for r in rows)
    by = {r["page_id"]: r["text"] for r in rows}
    assert by[1] == "A <B> First line second line. Unclosed bold" and by[2] == by[3] == "" and by[None] == LONG.strip()
    assert extract(spark.createDataFrame([], schema)).count() == 0


def test_mixing(spark, docs, none):
    from tidelog.llm.mixing import mix_digest, mix_rows

    rows = mix_digest(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    sizes = {}
    for r in rows:
        sizes.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    # two sources have the same size
    assert all(min(abs(sum(t) - m * target) for m in (1, 2)) <= 2 + len(t) for (_, target), t in sizes.items())
    assert sorted(map(str, rows)) == sorted(map(str, mix_digest(docs.repartition(7)).collect()))
    mixed = mix_rows(docs)
    assert mixed.columns == docs.columns
    words = sum(len((r["text"] or "").split()) for r in mixed.select("text").collect())
    assert abs(words - sum(r["taken"] for r in rows)) <= 20
    assert mix_digest(none).count() == 0 and mix_rows(none).count() == 0
