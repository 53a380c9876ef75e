"""Cases that tables seldom hold: repeated ids, boilerplate of any hash, special tokens, odd urls, late passages, odd pipelines."""

import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_llm_exact import brute_components, family  # noqa: E402

DOCS = "doc_id long, text string, source string"


def some(n, tag):
    return " ".join(f"{tag}{k}" for k in range(n))


# --- near duplicates -------------------------------------------------------------------------------------------------------


def test_each_row_of_an_id_stays_with_its_own_group(spark):
    from tidelog.llm.near_dedup import keep_one

    a, b, c = some(40, "a"), some(40, "b"), some(40, "c")
    rows = [(3, a), (7, a), (7, b), (8, b), (9, c), (9, c + " end"), (None, a)]
    kept = keep_one(spark.createDataFrame([(*r, "s") for r in rows], DOCS))
    got = sorted((r["doc_id"] or 0, r["text"][:2]) for r in kept.collect())
    assert got == [(0, "a0"), (3, "a0"), (7, "b0"), (9, "c0")]  # one text of 9, which is near itself


def test_lower_similarities(spark):
    from tidelog.llm import setsketch
    from tidelog.llm.near_dedup import near_duplicates

    assert [setsketch.bands_for(p) for p in (95, 80, 70, 60, 50, 30)] == [(32, 4)] * 3 + [(64, 3)] * 2 + [(128, 2)]
    with pytest.raises(ValueError):
        setsketch.bands_for(10)
    r = random.Random(8)
    docs = list(enumerate([t for edits in (4, 12, 20) for t in family(r, 12, edits)]))
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=3, percent=50).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == brute_components(docs, 3, 50)


# --- line rules --------------------------------------------------------------------------------------------------------------


def test_header_and_footer(spark):
    """Both are counted in every document, whatever their hashes are, and go from the texts that are kept."""
    from tidelog.llm.line_rules import boilerplate, keep_good, measured

    for footer in ("the last line of all of these pages here", "another last line for all of them"):
        texts = [(i, f"a header that stands above every page of this host\n{some(30, f'own{i}x')}\n{footer}", "h") for i in range(60)]
        docs = spark.createDataFrame(texts, DOCS)
        assert [r["n_docs"] for r in boilerplate(measured(docs)).collect()] == [60, 60]
        kept = keep_good(docs).collect()
        assert {r["doc_id"]: r["text"] for r in kept} == {i: some(30, f"own{i}x") for i in range(60)}


def test_verdicts_are_of_texts(spark):
    """Rows of one id, and rows without id, are judged each by its own text; other columns and blank lines stay."""
    from tidelog.llm.line_rules import keep_good

    good = f"{some(20, 'g')}\n\n  \n{some(12, 'h')}"
    rows = [(1, good, "s", 5, "x"), (1, "too short", "s", 6, "y"), (None, good, None, 7, None), (None, "short", None, 8, None), (2, None, "s", 9, "z")]
    docs = spark.createDataFrame(rows, DOCS + ", n_chars long, rid string")
    kept = keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, docs.where("n_chars in (5, 7)").collect()))


# --- token files -------------------------------------------------------------------------------------------------------------

PIECES = ["<|startoftext|>", "<|STARTOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|", "|>", "startoftext", "STARTOFTEXT", " ", "Hi", "hi", "'s", "É", "\n", "x|>"]


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=1, max_size=4))
def test_special_tokens_of_any_case(texts):
    """Also after other texts have been remembered: the coder is one for all examples."""
    from tidelog.llm.token_files import coder, tokenizer_path

    c = coder(open(tokenizer_path(), encoding="utf-8").read())
    got = np.concatenate([x[2] for x in c.encode(pa.array(texts), 1)]).tolist()
    assert got == [i for t in texts for i in [*c.tokenizer.encode(t, add_special_tokens=False).ids, 1]]


# --- WARC ----------------------------------------------------------------------------------------------------------------------


def test_any_url_gives_records(spark):
    from tidelog.llm import warc

    urls = ["http://a/\r\n\r\nX: y", "http://a/\nWARC-Type: request", " http://a/ ", "http://a/\x00\x7f", "", None, "http://a/é", "\r\n", "a b"]
    pages = spark.createDataFrame([(k, u, f"<p>text {k}") for k, u in enumerate(urls)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert sorted((r["page_id"], r["warc_type"]) for r in rows) == sorted((k, t) for k in range(len(urls)) for t in ("conversion", "metadata"))
    assert {r["page_id"]: r["content"] for r in rows if r["warc_type"] == "conversion"} == {k: f"text {k}" for k in range(len(urls))}
    assert {r["target_uri"] for r in rows if r["page_id"] == 0} == {"http://a/%0D%0A%0D%0AX: y"}
    for r in rows:
        headers, _ = warc.parse(bytes(r["record"]))
        assert warc.get(headers, "WARC-Target-URI") == r["target_uri"] and [k for k, _ in headers].count("WARC-Type") == 1


def test_character_set_late_in_the_head():
    from tidelog.llm import warc

    page = f"<html><head><title>t</title><style>{'x' * 5000}</style><meta charset=latin-1></head><body><p>é".encode("latin-1")
    assert warc.decoded([("Content-Type", "text/html")], page).endswith("é")
    assert warc.decoded([], "<html><head></head><body><p>é <meta charset=latin-1>".encode()).count("é") == 1


def test_pages_of_the_table(spark, sf_dir):
    """The query against a plain reading of each page."""
    import hashlib
    import re
    import uuid
    from base64 import b32encode
    from html import unescape

    from tidelog.llm.queries import op7_warc

    def digest(raw):
        return "sha1:" + b32encode(hashlib.sha1(raw).digest()).decode()

    rows = op7_warc(spark, sf_dir).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert sorted((r["page_id"], r["warc_type"]) for r in rows) == sorted((k, t) for k in pages for t in ("conversion", "metadata"))
    for r in rows:
        page = pages[r["page_id"]]
        raw = page["html"].encode()
        assert r["refers_to"] == f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, page['url'] + '#' + str(page['page_id']))}>"
        assert r["target_uri"] == page["url"] and r["source_digest"] == digest(raw) and r["block_digest"] == digest(r["content"].encode()) and r["n_bytes"] == len(r["content"].encode())
        if r["warc_type"] == "conversion":
            shown = re.sub(r"(?s)<(script|style|title|textarea|button|select|noscript|iframe)\b.*?</\1>|<!--.*?-->", " ", page["html"][page["html"].index("<body") :])
            assert "".join(r["content"].split()) == "".join(unescape(re.sub(r"<[^>]*>", "", shown)).split())


# --- decontamination -----------------------------------------------------------------------------------------------------------


def test_short_items_match_whole_documents(spark):
    from tidelog.llm.decontaminate import keep_clean, leaks

    docs = spark.createDataFrame([(1, " Tiny  Item "), (2, "a tiny item in a text"), (3, ""), (4, None), (5, "tiny item")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "tiny item"), (2, ""), (3, "other")], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["n_windows"], r["edits"]) for r in leaks(docs, items).collect()) == [(1, 1, 1, 0), (5, 1, 1, 0)]
    assert sorted(r["doc_id"] for r in keep_clean(docs, items).collect()) == [2, 3, 4]


def test_a_passage_at_the_end_of_a_long_document(spark):
    from tidelog.llm import decontaminate

    r = random.Random(1)
    item = " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(40))
    filler = some(120_000, "w")
    assert len(filler) > decontaminate.SCAN_CHARS
    docs = spark.createDataFrame([(1, filler + " " + item[30:150]), (2, filler)], "doc_id long, text string")
    items = spark.createDataFrame([(9, item)], "item_id long, text string")
    assert [(x["doc_id"], x["item_id"]) for x in decontaminate.leaks(docs, items).collect()] == [(1, 9)]


# --- classifiers -----------------------------------------------------------------------------------------------------------------


def test_the_sample_is_the_first_by_hash(spark):
    """A bound on the hash sends fewer rows to the driver and takes the same ones."""
    from tidelog.llm.quality import first_of

    rows = [(i, f"{zlib.crc32(str(i).encode()):08x}" * 4) for i in range(5000)]
    pool = spark.createDataFrame(rows, "doc_id long, o string")
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    for most in (1, 50, 1000, 6000):
        assert [r["doc_id"] for r in first_of(pool, most).collect()] == want[:most]
    assert first_of(pool.where("false"), 10).count() == 0


def test_vectors_are_learned():
    """Without any statistics the network still learns what some words and their forms mean; a quarter of the texts is held out."""
    from tidelog.llm.bytetext import blocks, buffers
    from tidelog.llm.toxicity import Model, Words, slots_of, spelled, spelling

    r = random.Random(2)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(3, 8)))
    texts, y = [], []
    for k in range(480):
        w = [word() for _ in range(r.randint(5, 28))]
        if k % 3 == 0:
            w[r.randrange(len(w))] = r.choice(["zquark", "blorfid", "vexxil", "grunk"]) + r.choice(["", "s", "ed"])
        texts.append(" ".join(w))
        y.append(int(k % 3 == 0))
    m = Model().fit(texts[:360], np.array(y[:360]), statistics=False)
    data, offs = buffers(pa.array(texts[360:]))
    score = np.concatenate([m.score(d, o) for _, _, d, o in blocks(data, offs)])
    truth = np.array(y[360:])
    assert (score[truth == 1][:, None] > score[truth == 0][None, :]).mean() > 0.7
    raw = np.frombuffer(b"hello hellooo xxxxxxxx abcabcabcabc", np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    vectors = np.random.default_rng(0).standard_normal((1 << 14, 4)).astype(np.float32)
    assert np.allclose(spelled(vectors, slots_of(w), w.gram_first), spelled(vectors, *spelling(w)), atol=1e-5)


def test_passages_at_any_offset_stand_whole_in_a_window():
    from tidelog.llm.toxicity import STRIDE, WINDOW, Words

    raw = np.frombuffer(" ".join("w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(200)).encode(), np.uint8)
    w = Words(raw, np.array([0, len(raw)]))
    rows, _ = w.windows()
    held = [set(r[r >= 0].tolist()) for r in rows]
    for size in (1, 18, WINDOW - STRIDE + 1):
        for at in range(200 - size + 1):
            assert any(set(w.order[at : at + size].tolist()) <= h for h in held)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_toxic_rows_are_found(spark):
    """Of the labelled toxic documents that hold a word which tells, nearly all are found, and clean ones are left alone."""
    from tidelog.llm.toxicity import scored

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    text = {r["doc_id"]: set((r["text"] or "").lower().replace(".", " ").replace(",", " ").split()) for r in docs.collect()}
    tell = {"idiot", "moron", "clown", "scum", "loser", "trash", "pathetic", "stupid", "worthless", "disgusting"}
    rows = [(r["predicted"], toxic[r["doc_id"]], bool(text[r["doc_id"]] & tell), r["held_out"]) for r in scored(docs, labels).collect() if r["doc_id"] in toxic]
    found = [p for p, t, told, _ in rows if t and told]
    held = [p for p, t, told, h in rows if t and told and h]
    wrong = [p for p, t, _, h in rows if not t and h]
    assert sum(found) >= 0.9 * len(found) and sum(held) >= 0.9 * len(held) and sum(wrong) <= 0.02 * len(wrong)


# --- pipeline --------------------------------------------------------------------------------------------------------------------


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; null and repeated ids, null texts and sources, and columns of clashing names."""
    import corpus_pipeline as P

    text = [f"{some(30, f'{c}x')}\nand a line of its own {c}" for c in "abcdef"]
    rows = [(1, text[0], "en", "s", 9, "k"), (1, text[1], "en", "s", 9, None), (None, text[2], None, None, None, "k"), (None, None, None, None, None, None), (2, text[0], "en", "s", 1, "k"), (3, text[3], "en", "", 1, "k"), (4, "short", "en", "s", 5, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    bench = spark.createDataFrame([(1, some(30, "dx")), (None, None)], "item_id long, text string")
    for name, some_rows, ids in (("odd", rows, {1, None}), ("none", [], set())):
        spark.createDataFrame(some_rows, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}/documents.parquet")
        for _, stage in P.STAGES[:3]:
            docs = stage(spark, docs, f"{tmp_path}/{name}")
            assert docs.columns == schema.replace(" long", "").replace(" string", "").split(", ")
        assert {r["doc_id"] for r in docs.collect()} == ids
        out = P.run(spark, f"{tmp_path}/{name}").collect()
        assert {r["doc_id"] for r in out} <= ids and bool(out) == bool(ids)
