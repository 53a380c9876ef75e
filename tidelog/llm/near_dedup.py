"""Near-duplicate detection with SetSketch registers.

1. One pass over the texts gives each document's set of word shingles, as a 128-bit class id and M registers.
2. Documents with the same set form a class; everything after works on classes, so copies cost nothing.
3. Registers are banded; each bucket's members are compared with its least member (its leader), first by the joint likelihood
   estimate from all registers, then on the full sets. Links give components.
4. In buckets that still hold several components, members of different components are compared inside the task, in blocks of
   bounded size: by their registers, in the first band that they share, and where these leave a doubt on the full sets. Only one link
   for each two components leaves the task. The leader's component, as a rule nearly the whole bucket, is dealt to blocks once; the
   few others meet each of its blocks and one another, so a large group of near copies costs in proportion to its size.

No pairs inside a component are looked at, and every link counts only after the full sets confirm it. Joins by bucket, leader and
hub have stored tables on both sides, so that adaptive execution splits the key of a large family of near copies among many tasks.

A row is known by its key, a digest of its id and its text, so rows of equal id and other texts never stand for one another.

Defined cases: a null or empty text has an empty set and is linked with nothing; a row without id takes no part and is kept, with
a null component; rows of equal id are judged each by its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setsketch
from .bytetext import U, blocks, buffers, mix, shingle_sets
from .common import discard, save, ship, temporary

#: Candidates are given up without a look at the full sets if a similarity below the limit is e**CUT times as likely as any above.
CUT = 10.0
#: Members of a bucket, and their shingles, in one block.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 2_000_000


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Arrow batches of at most n rows in what runs inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """16 bytes for each set, the same for equal sets."""
    out = np.zeros((len(sets), 2), U)
    for i, s in enumerate(sets):
        out[i, 0] = np.bitwise_xor.reduce(mix(s + U(0x632BE59BD9B4E019))) + U(len(s))
        out[i, 1] = np.add.reduce(mix(s ^ U(0xD1B54A32D192ED03)))
    return mix(out)


def _binary(raw: np.ndarray, width: int, empty=None):
    """An Arrow binary array of rows of ``width`` bytes; null where ``empty``."""
    import pyarrow as pa

    n = len(raw)
    a = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(np.ascontiguousarray(raw).tobytes())])
    if empty is None or not empty.any():
        return a
    import pyarrow.compute as pc

    return pc.if_else(pa.array(empty), pa.scalar(None, pa.binary()), a)


def row_key(doc_id, text):
    """16 bytes that tell rows of other ids or other texts apart."""
    digest = lambda c: F.md5(c.cast("string").cast("binary"))
    return F.unhex(F.md5(F.concat(F.coalesce(digest(doc_id), F.lit("-")), F.coalesce(digest(text), F.lit("-"))).cast("binary")))


def sketched(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, k (its row key), n_shingles, cid and sketch (null without shingles or id)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j, d, o in blocks(data, offs):
                sets = shingle_sets(d, o, width)
                n = np.array([len(s) for s in sets], np.int64)
                gone = (n == 0) | b.column(0).slice(i, j - i).is_null().to_numpy(zero_copy_only=False)
                regs = setsketch.registers(sets)
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(n)]
                yield pa.RecordBatch.from_arrays([*cols, _binary(class_ids(sets), 16, gone), _binary(regs, 2 * setsketch.M, gone)], ["doc_id", "k", "n_shingles", "cid", "sketch"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(F.col(id_col), F.col(text_col)).alias("k"))
    return rows.mapInArrow(run, f"doc_id {kind}, k binary, n_shingles long, cid binary, sketch binary")


def _regs(column) -> np.ndarray:
    data, _ = buffers(column)
    return data.view(np.uint16).reshape(-1, setsketch.M)


def banded(classes: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """key, node: one row for each class and band; shape: bands, registers of each."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                keys = setsketch.band_keys(_regs(b.column(1)), shape)
                node = np.repeat(b.column(0).to_numpy(), shape[0])
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(node)], ["key", "node"])

    return classes.select("node", "sketch").mapInArrow(run, "key long, node long")


def likely(pairs: DataFrame, classes: DataFrame, at: float) -> DataFrame:
    """Of pairs (a, b) those that the joint estimate doesn't rule out."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                x, y = _regs(b.column(3)), _regs(b.column(5))
                na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
                _, lead = setsketch.estimate((x > y).sum(1), (x < y).sum(1), na, nb, at)
                keep = pa.array((lead <= CUT) & (np.minimum(na, nb) >= at * np.maximum(na, nb) - 1e-9))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "sa", "nb", "sb")
    return both.mapInArrow(run, "a long, b long")


def with_text(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node, text for classes (node, k). Of the rows that repeat a document, which come one after another, one is taken; where a task
    holds only part of them, one of each task, which makes work but no difference."""

    def run(batches):
        import pyarrow as pa

        last = None
        for b in batches:
            if b.num_rows:
                node = b.column(0).to_numpy()
                first = np.concatenate(([node[0] != last], node[1:] != node[:-1]))
                last = node[-1]
                yield b.filter(pa.array(first))

    d = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("k"), F.col(text_col).alias("text"))
    return nodes.select("node", "k").join(d, "k").select("node", "text").mapInArrow(run, "node long, text string")


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                nodes = np.concatenate([b.column(0).to_numpy(), b.column(1).to_numpy()])
                _, some, back = np.unique(nodes, return_index=True, return_inverse=True)
                both = pa.concat_arrays([b.column(2), b.column(3)]).take(pa.array(some))
                sets: list[np.ndarray] = []
                data, offs = buffers(both)
                for _, _, d, o in blocks(data, offs):
                    sets += shingle_sets(d, o, width)
                half = b.num_rows
                keep = np.zeros(half, bool)
                for k in range(half):
                    x, y = sets[back[k]], sets[back[half + k]]
                    i = overlap(x, y)
                    keep[k] = i > 0 and 100 * i >= percent * (len(x) + len(y) - i)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, put) -> DataFrame:
    """node, label for the nodes of ``edges`` (a, b), by alternating large and small stars; the label is the component's least node.
    The neighbours' minima are stored before they are joined, so that the edges of a hub can be dealt to many tasks. put: ``save``, of
    tables that outlive the result."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "edge-least")
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = save(large.groupBy("u").agg(F.min("v").alias("m")), "edge-least")
        small = large.join(least, "u")
        new = put(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "edges")
        discard(e, near, least)
        e = new
        roles = e.select(F.col("u").alias("n"), F.lit(1).alias("c"), F.lit(0).alias("p")).union(e.select("v", F.lit(0), F.lit(1)))
        if roles.groupBy("n").agg(F.sum("c").alias("c"), F.max("p").alias("p")).where("c > 1 or c = 1 and p = 1").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


class Block:
    """Members of one bucket (or of two of its parts): links between those of different components."""

    def __init__(self, key: int, node, label, mine, n, text, regs, width: int, percent: int):
        self.node, self.label, self.mine, self.n, self.text, self.regs = node, label, mine, n, text, regs
        self.width, self.percent, self.at = width, percent, percent / 100
        shape = setsketch.bands_for(percent)
        band = int((setsketch.band_keys(regs[:1], shape)[0] == key).argmax())
        self.before = regs[:, : band * shape[1]].reshape(len(regs), band, shape[1])
        self.sets: dict[int, np.ndarray] = {}
        self.root: dict[int, int] = {}

    def _set(self, k: int) -> np.ndarray:
        if k not in self.sets:
            raw = np.frombuffer(self.text[k].encode("utf-8", "replace"), np.uint8)
            self.sets[k] = shingle_sets(raw, np.array([0, len(raw)]), self.width)[0]
        return self.sets[k]

    def _find(self, x: int) -> int:
        while (up := self.root.get(x, x)) != x:
            self.root[x] = self.root.get(up, up)
            x = up
        return x

    def links(self, apart: bool):
        """Pairs of nodes. Each pair of components needs one link only; a pair is looked at in the first band it shares."""
        names, code, count = np.unique(self.label, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return
        n, regs, node = self.n, self.regs, self.node
        floor = int(setsketch.M * (self.at - 0.25))
        largest = code == count.argmax()
        rows = np.flatnonzero(~largest)
        for s in range(0, len(rows), 16):
            r = rows[s : s + 16]
            same = np.stack([(regs[k] == regs).sum(1) for k in r])
            can = (same >= floor) & (code[r][:, None] != code[None, :]) & (largest[None, :] | (node[None, :] > node[r][:, None]))
            can &= np.minimum(n[r][:, None], n[None, :]) >= self.at * np.maximum(n[r][:, None], n[None, :]) - 1e-9
            if apart:
                can &= self.mine[r][:, None] != self.mine[None, :]
            x, y = np.nonzero(can)
            a, b = r[x], y
            fresh = ~(self.before[a] == self.before[b]).all(2).any(1)
            a, b, score = a[fresh], b[fresh], same[x, y][fresh]
            if not len(a):
                continue
            _, lead = setsketch.estimate((regs[a] > regs[b]).sum(1), (regs[a] < regs[b]).sum(1), n[a], n[b], self.at)
            for i in np.flatnonzero(lead <= CUT)[np.argsort(-score[lead <= CUT], kind="stable")].tolist():
                u, v = int(a[i]), int(b[i])
                p, q = self._find(int(code[u])), self._find(int(code[v]))
                if p == q:
                    continue
                shared = overlap(self._set(u), self._set(v))
                if shared and 100 * shared >= self.percent * (len(self.sets[u]) + len(self.sets[v]) - shared):
                    self.root[p] = q
                    yield int(min(node[u], node[v])), int(max(node[u], node[v]))


def across(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Of bucket members (key, node, label, base, settled, open, n, sketch, text): links (a, b) between different components, verified on
    the full sets inside the task. At most as many for each block as it has components.

    The members labelled ``base`` are dealt to the blocks 0 to settled - 1, the others to the following ``open`` ones; members of two blocks
    meet, other than those of two settled blocks."""
    part = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    blocks_ = F.col("settled") + F.col("open")
    spread = members.withColumn("mine", F.when(F.col("label") == F.col("base"), part(F.col("settled"))).otherwise(F.col("settled") + part(F.col("open"))))
    spread = spread.withColumn("other", F.explode(F.when(F.col("label") == F.col("base"), F.sequence(F.col("settled"), blocks_ - 1)).otherwise(F.sequence(F.lit(0), blocks_ - 1))))
    spread = spread.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")).drop("other")
    order = ["key", "i", "j"]
    spread = spread.repartition(*order).sortWithinPartitions(*order)

    def run(batches):
        import pyarrow as pa

        last, held = None, []

        def close():
            cols = [np.concatenate(c) for c in zip(*[h[:4] for h in held], strict=True)]
            block = Block(last[0], *cols, [t for h in held for t in h[4]], np.concatenate([h[5] for h in held]), width, percent)
            found = list(block.links(last[1] != last[2]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(k).to_numpy() for k in range(3)], 1)
            cols = [b.column(k).to_numpy() for k in range(3, 7)]
            regs = _regs(b.column(8))
            edge = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for s, t in zip(edge[:-1], edge[1:], strict=True):
                now = tuple(key[s].tolist())
                if last is not None and now != last:
                    yield from close()
                    held = []
                last = now
                held.append([*[c[s:t].copy() for c in cols], b.column(7).slice(s, t - s).to_pylist(), regs[s:t].copy()])
        if last is not None:
            yield from close()

    return spread.select(*order, "node", "label", "mine", "n", "text", "sketch").mapInArrow(run, "a long, b long").distinct()


def grouped(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketched documents, and of each class (cid) its component's least doc_id (component_id) and the row key of the document that
    stands for the component (keep)."""
    spark, at, shape = docs.sparkSession, percent / 100, setsketch.bands_for(percent)
    ship(spark)
    base = save(sketched(docs, width, id_col, text_col), "near-base")
    classes = base.where("cid is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "k")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = classes.select("cid", F.col("rep.doc_id").alias("doc"), F.col("rep.k").alias("k"), "n", "sketch")
    with temporary() as put:
        classes = put(classes.withColumn("node", F.monotonically_increasing_id()), "near-classes")
        bands = banded(classes, shape)
        buckets = put(bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).where("size > 1"), "near-buckets")
        members = put(bands.join(buckets, "key"), "near-members")
        texts = put(with_text(classes.join(members.select("node").distinct(), "node", "left_semi"), docs, id_col, text_col), "near-texts")
        pairs = likely(members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), classes, at)
        with arrow_rows(spark, 1000):
            links = put(verified(pairs, texts, width, percent), "near-links")
        labels = components(links, put)
        # every other pair of a bucket is one without its leader: it matters if their components still differ
        known = members.where("size > 2").select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        known = put(known.join(classes.select("node", "n"), "node"), "near-known")
        each = known.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), F.min("node").alias("m"))
        mixed = each.groupBy("key").agg(F.min_by(F.struct("label", "c", "s"), "m").alias("x"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("labels"))
        parts = lambda c, s: F.ceil(F.greatest(c / BLOCK_MEMBERS, s / BLOCK_SHINGLES)).cast("int")
        settled, open_ = parts(F.col("x.c"), F.col("x.s")), parts(F.col("c") - F.col("x.c"), F.col("s") - F.col("x.s"))
        mixed = put(mixed.where("labels > 1").select("key", F.col("x.label").alias("base"), settled.alias("settled"), open_.alias("open")), "near-mixed")
        open_members = known.join(mixed, "key").join(classes.select("node", "sketch"), "node").join(texts, "node")
        with arrow_rows(spark, 1000):
            more = put(across(open_members, width, percent), "near-links")
        whole = classes.select("node", "cid", "doc", "k").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        if not more.isEmpty():
            named = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            ends = more.join(named[0], "a", "left").join(named[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
            moved = components(ends, put).select(F.col("node").alias("old"), F.col("label").alias("to"))
            whole = whole.join(moved, whole["label"] == moved["old"], "left").withColumn("label", F.coalesce("to", "label")).drop("old", "to")
        roots = whole.groupBy("label").agg(F.min(F.struct("doc", "k")).alias("root"))
        final = save(whole.join(roots, "label").select("cid", F.col("root.doc").alias("component_id"), F.col("root.k").alias("keep")), "near-components")
    return base, final


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least doc_id reachable over links of at least ``percent``), kept."""
    base, final = grouped(docs, width, percent, id_col, text_col)
    out = base.select("doc_id", "n_shingles", "cid").join(final, "cid", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: that of the least id, and of its texts in the group one. Rows that repeat it stay with it;
    a row of the same id whose text belongs to another group is judged there; rows without id stay."""
    base, final = grouped(docs, width, percent, id_col, text_col)
    gone = base.join(final, "cid").where("k != keep").select(F.col("k").alias("_gone")).distinct()
    return docs.join(gone, row_key(docs[id_col], docs[text_col]) == gone["_gone"], "left_anti")


#: The op1 contract with exact set arithmetic.
ORACLE = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM t WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
h AS (SELECT doc_id, hash(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM h a JOIN h b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT g.b, c.root FROM c JOIN g ON g.a = c.doc_id WHERE c.root < g.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id, d.doc_id = m.root AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(root) AS root FROM c GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
