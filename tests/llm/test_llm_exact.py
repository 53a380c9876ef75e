"""Operators against brute force, exact round trips and held-out accuracy."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st


def words(text):
    return "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if text else []


def shingles(text, width):
    w = [x for x in words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_components(docs, width, percent):
    ids = [d for d, _ in docs]
    sets = [shingles(t, width) for _, t in docs]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in zip(ids, sets, strict=True)}


def family(r, n, edits):
    """Copies of one text, each with some words changed."""
    base = [f"w{r.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"e{r.randrange(5000)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_are_exact(spark, monkeypatch):
    from tidelog.llm import near_dedup

    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 16)  # buckets in several blocks
    r = random.Random(5)
    texts = [t for edits in (0, 1, 3, 5, 6, 8) for t in family(r, 25, edits)] + [" ".join(f"u{r.randrange(300)}" for _ in range(r.randint(1, 60))) for _ in range(60)] + ["a b c", "A  b\tC", "", "a b"]
    docs = list(enumerate(texts))
    r.shuffle(docs)
    want = brute_components(docs, 4, 80)
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in rows} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in rows)


def test_repeated_rows_are_one_class(spark):
    """A third of all rows repeats one row; some others are near it, or share its id with another text."""
    from tidelog.llm.near_dedup import near_duplicates

    r = random.Random(9)
    near = family(r, 12, 3)
    rows = [(5, near[0])] * 400 + [(100 + i, t) for i, t in enumerate(near[1:])] + [(5, "another text of this id"), (7, "another text of this id")] + [(1000 + i, " ".join(f"v{r.randrange(900)}" for _ in range(40))) for i in range(60)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert len(got) == len(rows)
    want = brute_components([(k, t) for k, (_, t) in enumerate(rows)], 4, 80)
    least: dict = {}
    for k, (d, _) in enumerate(rows):
        least[want[k][1]] = min(d, least.get(want[k][1], d))
    expected = sorted((d, want[k][0], least[want[k][1]]) for k, (d, _) in enumerate(rows))
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in got) == expected


def test_sketch_is_mergeable_and_unbiased():
    from tidelog.llm import setsketch

    r = np.random.default_rng(3)
    a, b = r.integers(0, 2**63, 3000).astype(np.uint64), r.integers(0, 2**63, 3000).astype(np.uint64)
    a[:2000] = b[:2000]
    x, y, z = setsketch.registers([a, b, np.concatenate([a, b])])
    assert (setsketch.merge(x, y) == z).all()
    j, lead = setsketch.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([3000]), np.array([3000]), 0.8)
    assert abs(j[0] - 0.5) < 0.12 and lead[0] > 10
    assert (setsketch.registers([np.zeros(0, np.uint64)]) == 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n☃ .'", max_size=30)), max_size=6))
def test_words_and_shingles(texts):
    from tidelog.llm.bytetext import blocks, buffers, shingle_sets, word_bounds

    data, offs = buffers(pa.array(texts, pa.string()))
    for _, _, d, o in blocks(data, offs, 16):
        starts, ends, first = word_bounds(d, o)
        assert len(starts) == len(ends) == first[-1]
    got = [len(s) for _, _, d, o in blocks(data, offs, 16) for s in shingle_sets(d, o, 3)]
    assert got == [len(shingles(t, 3)) for t in texts]


def test_leaks_are_exact():
    from tidelog.llm.decontaminate import Index, budget, normal, windows

    def edits(w, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(w, 1):
            new = [i]
            for j, x in enumerate(t, 1):
                new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    r = random.Random(2)
    letters = "abcdefghij"
    items = [(k, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 60)))) for k in range(12)]
    index = Index(items)
    for _ in range(120):
        _, item = r.choice(items)
        _, w = r.choice(windows(normal(item)))
        y = list(w)
        for _ in range(r.randint(0, budget(len(w)) + 3)):
            p = r.randrange(len(y))
            r.choice([lambda: y.__setitem__(p, r.choice("xyz ")), lambda: y.pop(p) if len(y) > 1 else None, lambda: y.insert(p, r.choice("xyz"))])()
        text = normal("foo " * r.randint(0, 9) + "".join(y) + " bar" * r.randint(0, 9))
        found = {index.text[v[1]] for v in index.find([text])}
        assert (w in found) == (edits(w, text) <= budget(len(w)))


def test_leaks_in_tables(spark, sf_dir):
    """Whole items that stand in a document are found, and nothing where no long part of an item stands."""
    from tidelog.llm.decontaminate import leaks, normal

    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    texts = {r["doc_id"]: normal(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: normal(r["text"]) for r in bench.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in leaks(docs, bench).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got
    for d, i in got:
        assert any(items[i][k : k + 20] in texts[d] for k in range(len(items[i]) - 19))


def test_blocks_of_items_change_nothing(spark, sf_dir, monkeypatch):
    from tidelog.llm import decontaminate

    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(str, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3000)
    assert sorted(map(str, decontaminate.leaks(docs, bench).collect())) == whole
    assert decontaminate.keep_clean(docs, bench).count() == docs.count() - len({x.split(",")[0] for x in whole})


@pytest.mark.parametrize("width", [1, 3, 8, 12, 13, 16, 17, 20, 31, 32])
def test_packing(width):
    from tidelog.llm.token_files import pack, unpack, width_of

    ids = np.random.default_rng(width).integers(0, 2**width, 10_007).astype(np.uint32)
    raw = pack(ids, width)
    assert len(raw) == -(-len(ids) * width // 8)
    assert (unpack(raw, width, 5000, 777) == ids[777:5777]).all() and (unpack(raw, width, len(ids)) == ids).all()
    assert width_of(2**width) == width and width_of(1) == 1


def test_token_files_random_access(tmp_path, monkeypatch):
    from tidelog.llm import token_files

    monkeypatch.setattr(token_files, "BLOCK_IDS", 64)
    r = np.random.default_rng(1)
    docs = [r.integers(0, 5000, r.integers(1, 300)).astype(np.uint32) for _ in range(50)]
    w = token_files.Writer(f"file://{tmp_path}/x.tok", 13)
    for k in range(0, 50, 10):
        w.add([None if k + i == 0 else k + i for i in range(10)], np.concatenate(docs[k : k + 10]), np.array([len(d) for d in docs[k : k + 10]]))
    w.close()
    f = token_files.Reader(f"file://{tmp_path}/x.tok")
    for k in (49, 0, 17, 3):
        assert (f.document(k) == docs[k]).all()
    assert [d for d, _, _ in f.documents(500)][:2] == [None, 1] and all((x == y).all() for (_, _, x), y in zip(f.documents(500), docs, strict=True))
    (tmp_path / "bad.tok").write_bytes(b"0" * 200)
    with pytest.raises(ValueError):
        token_files.Reader(f"file://{tmp_path}/bad.tok")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aBé's.…€1٣\n İΣ#中😀-<|endoftx>", max_size=25), min_size=1, max_size=5))
def test_coder_is_the_tokenizer(texts):
    from tidelog.llm.token_files import coder, tokenizer_path

    c = coder(open(tokenizer_path(), encoding="utf-8").read())
    got = np.concatenate([x[2] for x in c.encode(pa.array(texts), 1)]).tolist()
    assert got == [i for t in texts for i in [*c.tokenizer.encode(t, add_special_tokens=False).ids, 1]]


def test_other_tokenizers(spark):
    """A tokenizer that words can't be encoded alone for."""
    from tokenizers import Tokenizer

    from tidelog.llm.token_files import WordCoder, token_digest, tokenizer_path

    path = tokenizer_path("byte_bpe_50k.json")
    assert not WordCoder.fits(open(path, encoding="utf-8").read())
    docs = spark.createDataFrame([(2, "Hello  world\n"), (1, None)], "doc_id long, text string")
    rows = token_digest(docs, path).orderBy("start").collect()
    ids = np.array([*Tokenizer.from_file(path).encode("Hello  world\n", add_special_tokens=False).ids, 1], "<u4")
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(1, 0, 1), (2, 1, len(ids))] and rows[1]["ids_crc32"] == zlib.crc32(ids.tobytes())


def test_html_of_the_tables(spark, sf_dir):
    """The tables' pages have their main text in one article element, so a plain reading of it is the truth."""
    import html
    import re

    from tidelog.llm.html_text import extract

    def truth(h):
        a = h[h.index("<article>") + 9 : h.index("</article>")]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", a))).split())

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r["page_id"]: truth(r["html"]) for r in pages.collect()}
    assert {r["page_id"]: r["text"] for r in extract(pages).collect()} == want


def test_html_of_other_shapes():
    """Invented pages that the trees weren't trained on."""
    import re

    from tidelog.llm.html_text import decode, main_texts, model, sample_page

    r = random.Random(12345)
    pages = [sample_page(r) for _ in range(150)]
    exact = 0
    for page, text in zip(pages, main_texts(pages, model()), strict=True):
        want = set(re.findall(r"Q[a-z]+", re.sub(r"<[^>]*>", " ", page)))
        got = set(re.findall(r"\b[Qz][a-z]+", text))
        exact += got == want
    assert exact >= 0.97 * len(pages)
    # nothing is kept below what is dropped
    assert decode([-1, 0, 1, 1], np.array([5.0, -9.0, 2.0, 1.0])) == [True, False, False, False]
    assert decode([-1, 0, 1, 1], np.array([5.0, -2.0, 2.0, 1.0])) == [True, True, True, True]


def test_boosting_learns():
    from tidelog.llm.gbt import Boosted

    r = np.random.default_rng(0)
    x = r.standard_normal((2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = Boosted(trees=40).fit(x[:1500], y[:1500])
    assert ((m.score(x[1500:]) > 0) == (y[1500:] == 1)).mean() > 0.95


def test_index_only_spares_work():
    from tidelog.llm.url_rules import PATTERN_RULES, PatternIndex, lowered

    r = random.Random(3)
    words = ["spam", "farm", "spam-farm", "cheap-pills", "casino", "free-casino", "ads1", "banner", "affiliate_id=7", "x", "affiliate", "Cheap-Pills"]
    urls = ["http://" + ".".join(r.choice(words) for _ in range(2)) + ".org/" + "/".join(r.choice(words) for _ in range(2)) + r.choice(["", "?affiliate_id=3", "?a=b"]) for _ in range(500)]
    import re

    for counts in ({}, {"spam": 9, "farm": 1}, {"pills": 5}):
        index = PatternIndex(PATTERN_RULES, counts)
        assert [index.hit(u) for u in urls] == [any(re.search(p.pattern, lowered(u)) for p in PATTERN_RULES) for u in urls]


def test_warc_files(spark, tmp_path):
    """Written and read again, gzipped and plain; derived records link to their source and carry right digests."""
    import json

    from tidelog.llm import warc

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<html><head><title>T{i}</title></head><body><p>Text {i} é</p><a href='/l{i}'>go</a></body></html>") for i in range(20)], "page_id long, url string, html string")
    source = warc.responses(pages)
    files = warc.write_files(source, f"file://{tmp_path}/w").collect()
    assert sum(f["n_records"] for f in files) == 20
    back = warc.read_files(spark, [f["path"] for f in files])
    raw = sorted(bytes(r["record"]) for r in source.collect())
    assert sorted(bytes(r["record"]) + b"\r\n\r\n" for r in back.collect()) == raw
    (tmp_path / "plain.warc").write_bytes(b"".join(raw))
    assert [r["position"] for r in warc.read_files(spark, [f"file://{tmp_path}/plain.warc"]).orderBy("position").collect()] == list(range(20))
    for r in source.collect():
        headers, block = warc.parse(bytes(r["record"]))
        (meta, told), (conversion, text) = warc.derive(bytes(r["record"]))
        name = warc.get(headers, "WARC-Record-ID")
        assert warc.get(meta, "WARC-Refers-To") == warc.get(conversion, "WARC-Refers-To") == name
        assert warc.get(conversion, "WARC-Target-URI") == warc.get(headers, "WARC-Target-URI") and warc.get(conversion, "WARC-Date") == warc.get(headers, "WARC-Date")
        assert warc.get(conversion, "WARC-Block-Digest") == warc.digest(text) and warc.get(meta, "WARC-Block-Digest") == warc.digest(told)
        facts = json.loads(told)
        assert facts["source"]["headers"]["WARC-Payload-Digest"] == warc.get(meta, "WARC-Source-Payload-Digest") == warc.digest(block.split(b"\r\n\r\n", 1)[1])
        assert facts["html"] == {"links": [{"path": "A@/href", "url": f"/l{r['page_id']}"}], "metas": [], "title": f"T{r['page_id']}"}
        assert facts["conversion"]["record_id"] == warc.get(conversion, "WARC-Record-ID") == warc.get(meta, "WARC-Concurrent-To")
        assert text.decode() == f"Text {r['page_id']} é\ngo"


def test_warc_other_responses():
    import gzip
    import json

    from tidelog.llm import warc

    def made(http, kind="response"):
        return warc.record([("WARC-Type", kind), ("WARC-Record-ID", "<urn:x:1>"), ("WARC-Target-URI", "http://a/")], http)

    derive = lambda http, **how: warc.derive(made(http, **how))
    assert derive(b"", kind="request") == []
    assert [warc.get(h, "WARC-Type") for h, _ in derive(b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\nno")] == ["metadata"]
    assert [warc.get(h, "WARC-Type") for h, _ in derive(b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89")] == ["metadata"]
    assert json.loads(derive(b"junk")[0][1])["http"] is None
    zipped = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress("<p>é".encode("latin-1"))
    assert derive(zipped)[1][1].decode() == "é"
    chunked = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=y\r\nde\r\n0\r\n\r\n"
    assert derive(chunked)[1][1] == b"abcde"
    assert warc.parse(b"WARC/1.0\r\nContent-Length: 50\r\n\r\nshort") is None


def accuracy(spark, rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_classifiers_hold_out(spark):
    """On labels that they never read."""
    from tidelog.llm.quality import classified
    from tidelog.llm.toxicity import scored

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = classified(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert accuracy(spark, rows, quality) > 0.97
    rows = scored(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert accuracy(spark, rows, toxic) > 0.93


def test_gradients():
    from tidelog.llm import toxicity as T

    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in T.start(r).items()}
    x, rows = r.standard_normal((9, T.INPUTS)), np.sort(r.integers(-1, 9, (5, 7)), 1)[:, ::-1].copy()
    d = r.standard_normal(5)
    _, kept = T.forward(p, x, rows, True)
    g, dx = T.backward(p, x, rows, kept, d)
    for k in ("xf", "hf", "cf", "xb", "hb", "cb", "att", "out"):
        i = tuple(r.integers(0, s) for s in p[k].shape)
        up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
        up[k][i] += 1e-3
        down[k][i] -= 1e-3
        assert abs(((T.forward(up, x, rows) - T.forward(down, x, rows)) * d).sum() / 2e-3 - g[k][i]) < 2e-3
    assert dx.shape == x.shape


def test_all_windows_are_read():
    from tidelog.llm.toxicity import STRIDE, WINDOW, Words

    for n in (0, 1, WINDOW, WINDOW + 1, WINDOW + STRIDE, 5 * WINDOW + 3):
        raw = np.frombuffer(" ".join(f"w{chr(97 + i % 26)}" for i in range(n)).encode(), np.uint8)
        w = Words(raw, np.array([0, len(raw)]))
        rows, text = w.windows()
        assert (rows >= 0).sum(1).max() <= WINDOW and len(text) == len(rows)
        covered = {k * STRIDE + j for k in range(len(rows)) for j in range(WINDOW) if rows[k, j] >= 0}
        assert covered == set(range(n))


def test_lines_count_real_documents(spark):
    """Documents that share all lines but one are as many as they are; copies count once."""
    from tidelog.llm.line_rules import judged

    template = [f"shared line {k} of the template with some words in it" for k in range(10)]
    rows = [(i, "\n".join([*template, f"own{i} word{i} x{i} y{i} z{i} v{i}"]), "h") for i in range(100)]
    rows += [(1000 + i, "one text with a line\nthat is copied and a line\nof its own to keep it", "h") for i in range(50)]
    got = {r["doc_id"]: (r["n_left_words"], r["kept"]) for r in judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i] == (6, False) for i in range(100)) and all(got[1000 + i] == (17, True) for i in range(50))


def test_each_text_of_a_repeated_id_is_found(spark):
    """Two texts of one id, each with a near copy, where every join is a sort-merge join."""
    from tidelog.llm.near_dedup import near_duplicates

    r = random.Random(4)
    one, two = family(r, 2, 1), family(r, 2, 1)
    rows = [(5, one[0]), (5, two[0]), (6, one[1]), (7, two[1])] + [(5, two[0])] * 3
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for some in (rows, rows[::-1]):
            got = near_duplicates(spark.createDataFrame(some, "doc_id long, text string").coalesce(1), width=4).collect()
            assert sorted((x["doc_id"], x["component_id"]) for x in got) == [(5, 5)] * 5 + [(6, 5), (7, 5)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_passages_are_found_at_every_offset():
    from tidelog.llm.decontaminate import Index, normal

    r = random.Random(6)
    letters = "abcdefghij"
    for size in (75, 100, 121, 240, 333):
        item = normal(" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 8))) for _ in range(90)))[:size]
        index = Index([(0, item)])
        for n in (74, 90, 150, 165):
            parts = [f"{'xyz ' * 20}{item[i : i + n]}{' zyx' * 20}" for i in range(size - n + 1)]
            assert {v[0] for v in index.find(parts)} == set(range(len(parts)))
        assert not list(index.find([f"xyz {item[i : i + 40]} zyx" for i in range(size - 40)]))


def test_a_large_host_spares_no_passage(spark):
    """A passage in 15 documents is boilerplate whatever else the host holds; a short line in as many is not."""
    from tidelog.llm.line_rules import judged

    passage = " ".join(f"passage{k}" for k in range(50))
    rows = [(i, f"{passage}\nown{i} a{i} b{i} c{i} d{i} e{i}", "h") for i in range(15)] + [(100 + i, f"see you soon\nown{i} p{i} q{i} r{i} s{i} t{i} u{i} v{i}", "h") for i in range(15)]
    for other in (0, 1500):
        more = [(1000 + i, " ".join(f"{c}{i}" for c in "abcdefghijkl"), "h") for i in range(other)]
        got = {r["doc_id"]: (r["n_left_words"], r["kept"]) for r in judged(spark.createDataFrame(rows + more, "doc_id long, text string, source string")).collect()}
        assert all(got[i] == (6, False) for i in range(15))
    assert all(got[100 + i] == (11, True) for i in range(15))


def test_item_ids_of_any_type(spark):
    from tidelog.llm.decontaminate import keep_clean, leaks

    text = "the quick brown fox jumps over the lazy dog near the old river bank today"
    docs = spark.createDataFrame([(1, f"so {text} it is"), (2, "nothing of the kind stands in here")], "doc_id long, text string")
    items = spark.createDataFrame([("mmlu/7", text)], "item_id string, text string")
    assert [(r["doc_id"], r["item_id"]) for r in leaks(docs, items).collect()] == [(1, "mmlu/7")]
    assert [r["doc_id"] for r in keep_clean(docs, items).collect()] == [2]
