"""Benchmark decontamination by q-gram lemma filtering.

Texts are lower-cased and their white space made single spaces. A benchmark item is looked for by windows of WINDOW characters
(the whole item where it is shorter), one every STRIDE, and of SHORT characters, one every STEP, each with an edit budget of RATE of
its characters; any verbatim passage of SHORT + STEP - 1 characters of an item holds a whole short window. An occurrence of a window of m
characters with at most e edits shares at least m - Q + 1 - Q * e of its q-grams with the document, on diagonals (place in the
document less place in the window) that differ by at most e. So shared q-grams are counted in overlapping bands of 2 (e + 1) diagonals, one
band starting every e + 1; bands that reach the bound name a region of the document, and a banded alignment of the window with
that region decides. The documents are scanned once, without a shuffle, by numpy over code points.

The benchmark is a query set: it is sent to the executors in blocks of at most BLOCK_CHARS characters, one scan for each block. With several
blocks each one's result is stored before the next is sent, so that one index at a time takes memory.

Defined cases: a null or empty text matches nothing; items of fewer than Q characters say too little to be looked for within texts, and
match documents that are equal to them as a whole; null and empty items match nothing; repeated documents and items are reported each; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import U, _powers, mix
from .common import discard, save, ship

Q, WINDOW, STRIDE, RATE = 12, 120, 60, 0.05
#: Of the short windows, for passages that hold no long one: 74 characters, some 12 words.
SHORT, STEP = 60, 15
#: Characters of benchmark text in one broadcast; its index takes some 170 bytes for each.
BLOCK_CHARS = 2_000_000
#: Characters of documents scanned at once.
SCAN_CHARS = 1 << 19
_BITS = 22


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(c: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q characters from each place on."""
    n = len(c)
    if n < Q:
        return np.zeros(0, U)
    pw, inv = _powers(n + 1)
    x = c.astype(U) * U(0x9E3779B97F4A7C15)
    x ^= x >> U(29)
    total = np.zeros(n + 1, U)
    np.cumsum(x * pw[:n], out=total[1:])
    return mix((total[Q:] - total[:-Q]) * inv[: n - Q + 1])


def windows(text: str) -> list[tuple[int, str]]:
    """(place, window) of an item's normalised text."""
    n = len(text)
    if n < Q:
        return []
    spans = [(i, m) for m, step in ((WINDOW, STRIDE), (SHORT, STEP)) for i in ([*range(0, n - m, step), n - m] if n > m else [0])]
    return [(i, text[i : i + m]) for i, m in dict.fromkeys((i, min(m, n)) for i, m in spans)]


def budget(m: int) -> int:
    """Edits allowed in a window of m characters; fewer than RATE asks for where the q-gram bound would otherwise be 0."""
    return min(int(m * RATE), (m - Q) // Q)


def distance(window: str, region: str, most: int) -> int:
    """Least edits between the window and any part of the region, or most + 1: an alignment row by row over the region's columns
    that lie in the band."""
    if window in region:
        return 0
    w, r = codes(window), codes(region)
    m, n = len(w), len(r)
    slack = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    width = max(0, n - m) + most
    for i in range(1, m + 1):
        a, b = max(0, i - 1 - most), min(n, i + width)
        new = np.full(n + 1, most + 1, np.int64)
        if a == 0:
            new[0] = i
        lo = max(a, 1)
        new[lo : b + 1] = np.minimum(row[lo - 1 : b] + (r[lo - 1 : b] != w[i - 1]), row[lo : b + 1] + 1)
        new[a : b + 1] = np.minimum.accumulate(new[a : b + 1] - slack[a : b + 1]) + slack[a : b + 1]
        row = np.minimum(new, most + 1)
        if row.min() > most:
            return most + 1
    return int(row.min())


class Index:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.item, self.text, self.place = [], [], []
        #: Windows that are items of fewer than Q characters, by their text.
        self.whole: dict[str, list[int]] = {}
        for k, text in items:
            text = normal(text)
            if 0 < len(text) < Q:
                self.whole.setdefault(text, []).append(len(self.item))
            for at, w in windows(text) if len(text) >= Q else [(0, text)] if text else []:
                self.item.append(k)
                self.text.append(w)
                self.place.append(at)
        g = [grams(codes(w)) for w in self.text]
        every = np.concatenate(g) if g else np.zeros(0, U)
        which = np.repeat(np.arange(len(g)), [len(x) for x in g]) if g else np.zeros(0, np.int64)
        at = np.concatenate([np.arange(len(x)) for x in g]) if g else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.which, self.at = which[order], at[order]
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every))
        self.length = np.array([len(w) for w in self.text], np.int64)
        self.edits = np.array([budget(len(w)) for w in self.text], np.int64)
        self.bound = self.length - Q + 1 - Q * self.edits
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(self.grams >> U(64 - _BITS)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> Iterator[tuple[int, int, int, int]]:
        """(number of the text, window, place in the text, edits) of all verified regions of normalised texts."""
        if self.whole:
            for d, text in enumerate(texts):
                for w in self.whole.get(text, ()):
                    yield d, w, 0, 0
        if not len(self.grams):
            return
        joined = "\n".join(texts)
        c = codes(joined)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        h = grams(c)
        pos = np.flatnonzero(self.bits[(h >> U(64 - _BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.grams, h[pos]), len(self.grams) - 1)
        real = self.grams[k] == h[pos]
        pos, k = pos[real], k[real]
        if not len(pos):
            return
        n = self.first[k + 1] - self.first[k]
        upto = np.cumsum(n)
        post = np.repeat(self.first[k] - (upto - n), n) + np.arange(upto[-1])
        pos = np.repeat(pos, n)
        win, off = self.which[post], self.at[post]
        doc = np.searchsorted(starts, pos, "right") - 1
        diagonal = pos - starts[doc] - off + WINDOW  # not negative
        step = self.edits[win] + 1
        band = diagonal // step
        rows = np.stack([np.concatenate([doc, doc]), np.concatenate([win, win]), np.concatenate([band, np.maximum(band - 1, 0)]), np.concatenate([off, off])], 1)
        rows = np.unique(rows, axis=0)
        edge = np.flatnonzero(np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(1))))
        count = np.diff(np.append(edge, len(rows)))
        rows = rows[edge]
        for d, w, b, _ in rows[count >= self.bound[rows[:, 1]]].tolist():
            e = int(self.edits[w])
            low = b * (e + 1) - WINDOW - e
            text = texts[d]
            a = max(0, low)
            region = text[a : max(a, low + 2 * (e + 1) + int(self.length[w]) + 2 * e)]
            found = distance(self.text[w], region, e)
            if found <= e:
                yield d, w, a, found


def scan(index: Index, column) -> Iterator[tuple[int, int, int, int]]:
    """As ``Index.find``, for an Arrow column of raw texts."""
    some: list[str] = []
    first = size = 0
    for k, text in enumerate([*column.to_pylist(), None]):
        last = k == len(column)
        if some and (last or size > SCAN_CHARS):
            for d, *rest in index.find(some):
                yield first + d, *rest
            some, size, first = [], 0, k
        if not last:
            some.append(normal(text))
            size += len(some[-1])


_LAST: list = [None, None]


def index_of(sent) -> Index:
    """This worker's index of a broadcast block; the last one is kept."""
    block = sent.value
    if _LAST[0] is not block:
        _LAST[:] = [block, Index(block)]
    return _LAST[1]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """(id in its own type, text) of the items."""
    some: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).toLocalIterator():
        if some and size + len(r[1]) > BLOCK_CHARS:
            yield some
            some, size = [], 0
        some.append((r[0], r[1]))
        size += len(r[1])
    if some:
        yield some


def one_by_one(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, search: Callable[[object], DataFrame]) -> Iterator[DataFrame]:
    """``search`` of each broadcast block of items; where there are several, its result is stored and the block let go."""
    blocks = item_blocks(benchmark, item_col, text_col)
    first, second = next(blocks, None), next(blocks, None)
    send = docs.sparkSession.sparkContext.broadcast
    if second is None:
        if first is not None:
            yield search(send(first))
        return
    for some in chain((first, second), blocks):
        sent = send(some)
        found = save(search(sent), "leaks")
        sent.destroy()
        yield found


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document that holds a part of a benchmark item: doc_id, item_id, n_windows (of the item's, long and short, found in
    the document), first_char (of the first, in the normalised text, within the edit budget), edits (least of any window)."""
    from pyspark.sql.pandas.types import to_arrow_type

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = to_arrow_type(benchmark.schema[item_col].dataType)
    schema = f"doc_id {kind}, item_id {benchmark.schema[item_col].dataType.simpleString()}, n_windows long, first_char long, edits long"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def search(sent) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            index = index_of(sent)
            for b in batches:
                found: dict[tuple[int, object], list] = {}
                for d, w, at, edits in scan(index, b.column(1)):
                    x = found.setdefault((d, index.item[w]), [set(), at, edits])
                    x[0].add(w)
                    x[1], x[2] = min(x[1], at), min(x[2], edits)
                if found:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([d for d, _ in found])), pa.array([i for _, i in found], item_kind), *[pa.array([f(x) for x in found.values()], pa.int64()) for f in (lambda x: len(x[0]), lambda x: x[1], lambda x: x[2])]], ["doc_id", "item_id", "n_windows", "first_char", "edits"])

        return rows.mapInArrow(run, schema)

    parts = list(one_by_one(docs, benchmark, item_col, item_text_col, search))
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no part of a benchmark item."""
    ship(docs.sparkSession)
    place, schema = docs.columns.index(text_col), docs.schema
    left = docs

    def search(sent) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            index = index_of(sent)
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for d, *_ in scan(index, b.column(place)):
                    keep[d] = False
                yield b.filter(pa.array(keep))

        return left.mapInArrow(run, schema)

    for kept in one_by_one(docs, benchmark, item_col, item_text_col, search):
        if left is not docs:
            discard(left)
        left = kept
    return left
