"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text is a sequence of words (runs of letters, lower-cased). A word's input joins a character part (the mean of the learned vectors of
all its character n-grams, with marks for its begin and end, and two statistics of them) and a word part (a learned vector of the
hashed word, and its statistic). The statistics say how much more often training documents with the label hold the n-gram or word than
others, less one standard error; in training each half's statistics come from the other half. Windows of WINDOW words that begin at every
STRIDE-th word, so that any WINDOW - STRIDE + 1 words stand whole in one, are read in both directions by gated recurrent units,
pooled by attention and scored; the text's score is that of its most toxic window.

The network is fitted on at most MAX_EACH labelled documents (without and with the label), those first in order of the md5 of their id, as far as
all their texts have MAX_CHARS characters. Whole texts are scored, every window of them. Label, language, source and id are never inputs.

Defined cases: null and empty texts, and texts without letters, are scored as one empty window; labels that are null or of missing
documents are left out, of several labels for one id the greatest counts, and of several texts of one id the least is fitted on; without training rows of both classes every score is
0.5; rows of equal id are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import LETTERS, U, blocks, buffers, mix, word_bounds, word_hashes
from .common import ship, temporary
from .quality import first_of, held_out, logistic

#: Labelled documents to be fitted on, without and with the label, and characters of their texts in all.
MAX_EACH, MAX_CHARS = (3000, 1500), 48_000_000
#: Words of a window, and from one window's first to the next one's.
WINDOW, STRIDE = 32, 8
GRAMS = (3, 4, 5, 6)
GRAM_BITS, WORD_BITS, VECTOR_BITS = 20, 18, 14
CHAR_DIM, WORD_DIM, HIDDEN = 4, 4, 8
INPUTS = 3 + CHAR_DIM + WORD_DIM


class Words:
    """The distinct words of a block of texts and, for each text, the order they come in."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, self.first = word_bounds(data, offs, LETTERS)
        h, some, self.order = np.unique(word_hashes(data, starts, ends, True), return_index=True, return_inverse=True)
        self.word = h
        size = ends[some] - starts[some]
        n = len(some)
        # every distinct word between marks, one after another
        wide = size + 2
        upto = np.cumsum(wide)
        raw = np.full(int(upto[-1]) if n else 0, 1, np.uint8)
        at = upto - wide
        inner = np.repeat(starts[some] - at - 1, size) + (np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at + 1, size))
        places = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at + 1, size)
        raw[places] = data[inner]
        raw[(raw >= 65) & (raw <= 90)] += 32
        c = mix(raw.astype(U) + U(7))
        last = np.repeat(upto, wide)
        grams, owner = [], []
        which = np.repeat(np.arange(n), wide)
        g = c.copy()
        for k in range(1, max(GRAMS)):
            if len(c) <= k:
                break
            g[: len(c) - k] = g[: len(c) - k] * U(0xD6E8FEB86659FD93) + c[k:]
            if k + 1 in GRAMS:
                ok = np.flatnonzero(np.arange(len(c)) + k < last)
                grams.append(mix(g[ok] + U(k)))
                owner.append(which[ok])
        grams, owner = (np.concatenate(grams), np.concatenate(owner)) if grams else (np.zeros(0, U), np.zeros(0, np.int64))
        by = np.argsort(owner, kind="stable")
        self.gram, self.owner = grams[by], owner[by]
        self.gram_first = np.searchsorted(self.owner, np.arange(n + 1))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Of all texts: a row of word numbers for each window (-1 past the text's end), and the text of each window."""
        n = np.diff(self.first)
        many = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        text = np.repeat(np.arange(len(n)), many)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE + self.first[text]
        at = begin[:, None] + np.arange(WINDOW)[None, :]
        rows = np.full(at.shape, -1, np.int64)
        there = at < self.first[text + 1][:, None]
        rows[there] = self.order[at[there]]
        return rows, text


class Table:
    """How much likelier a hashed feature is in documents with the label: log-odds ratio less one standard error, if positive."""

    def __init__(self, bits: int):
        self.bits, self.counts = bits, np.zeros((2, 1 << bits), np.float32)
        self.docs = np.zeros(2)

    def slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> U(64 - self.bits)).astype(np.int64)

    def add(self, h: np.ndarray, y: int) -> None:
        self.counts[y, np.unique(self.slot(h))] += 1
        self.docs[y] += 1

    def close(self) -> np.ndarray:
        t, n = self.counts[1], self.counts[0]
        a, b = max(self.docs[1], 1), max(self.docs[0], 1)
        odds = np.log((t + 0.5) / (a - t + 0.5)) - np.log((n + 0.5) / (b - n + 0.5))
        error = np.sqrt(1 / (t + 0.5) + 1 / (n + 0.5))
        return np.where(t > 0, np.clip(odds - error, 0, 8), 0).astype(np.float32) / 4


def slots_of(w: Words) -> np.ndarray:
    """Of each n-gram, the slot of its vector."""
    return (w.gram >> U(64 - VECTOR_BITS)).astype(np.int64)


def spelled(chars: np.ndarray, slots: np.ndarray, first: np.ndarray, share: np.ndarray | None = None) -> np.ndarray:
    """The mean vector of each word's n-grams; first: where each word's slots begin, and the end; share: of the word's n-grams, that of each
    slot, where slots aren't repeated."""
    if len(first) < 2:
        return np.zeros((0, CHAR_DIM), np.float32)
    if share is not None:
        return np.add.reduceat(chars[slots] * share[:, None], first[:-1], axis=0)
    return np.add.reduceat(chars[slots], first[:-1], axis=0) / np.diff(first)[:, None].astype(np.float32)


def spelling(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """slots, first and share for ``spelled``, each slot once a word: a word of any length has at most as many as there are vectors."""
    key, count = np.unique((w.owner << VECTOR_BITS) + slots_of(w), return_counts=True)
    owner = key >> VECTOR_BITS
    share = count / np.diff(w.gram_first)[owner] if len(owner) else count
    return (key & ((1 << VECTOR_BITS) - 1)).astype(np.uint16), np.searchsorted(owner, np.arange(len(w.word) + 1)).astype(np.int32), share.astype(np.float32)


def inputs(w: Words, gram: np.ndarray, word: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row for each distinct word, and the slots of their words' vectors."""
    n = len(w.word)
    if not n:
        return np.zeros((0, INPUTS), np.float32), np.zeros(0, np.int64)
    g = gram[(w.gram >> U(64 - GRAM_BITS)).astype(np.int64)]
    strong = np.maximum.reduceat(g, w.gram_first[:-1])
    mean = np.add.reduceat(g, w.gram_first[:-1]) / np.diff(w.gram_first)
    ws = (mix(w.word) >> U(64 - VECTOR_BITS)).astype(np.int64)
    own = word[(w.word >> U(64 - WORD_BITS)).astype(np.int64)]
    return np.concatenate([np.stack([strong, mean, own], 1), spelled(p["chars"], slots_of(w), w.gram_first), p["words"][ws]], 1).astype(np.float32), ws


def start(r: np.random.Generator) -> dict[str, np.ndarray]:
    p = {"chars": 0.05 * r.standard_normal((1 << VECTOR_BITS, CHAR_DIM)), "words": 0.05 * r.standard_normal((1 << VECTOR_BITS, WORD_DIM))}
    for d in ("f", "b"):
        p[f"x{d}"] = r.standard_normal((INPUTS, 3 * HIDDEN)) / np.sqrt(INPUTS)
        p[f"h{d}"] = r.standard_normal((HIDDEN, 3 * HIDDEN)) / np.sqrt(HIDDEN)
        p[f"c{d}"] = np.zeros(3 * HIDDEN)
    p |= {"att": r.standard_normal(2 * HIDDEN) * 0.3, "out": r.standard_normal(2 * HIDDEN) * 0.3, "bias": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(p: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray, keep: bool = False):
    """Log-odds of each window. x: inputs of the distinct words; rows: word numbers, -1 for none."""
    n, steps = rows.shape
    live = rows >= 0
    whole = live.all(0).tolist()
    states = np.zeros((n, steps, 2 * HIDDEN), x.dtype)
    saved: dict[str, list] = {"f": [], "b": []}
    for d, order, part in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, 2 * HIDDEN))):
        proj = np.concatenate([x @ p[f"x{d}"] + p[f"c{d}"], np.zeros((1, 3 * HIDDEN), x.dtype)])
        h = np.zeros((n, HIDDEN), x.dtype)
        wh = p[f"h{d}"]
        wg, wc = np.ascontiguousarray(wh[:, : 2 * HIDDEN]), np.ascontiguousarray(wh[:, 2 * HIDDEN :])
        for t in order:
            a = proj[rows[:, t]]
            gates = _sigmoid(a[:, : 2 * HIDDEN] + h @ wg)
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + (r * h) @ wc)
            new = h + z * (c - h)
            if not whole[t]:
                new = np.where(live[:, t, None], new, h)
            if keep:
                saved[d].append((t, h, z, r, c))
            h = new
            states[:, t, part] = h
    e = np.where(live, states @ p["att"], -1e9)
    e -= e.max(1, keepdims=True)
    a = np.exp(e) * (live | ~live.any(1, keepdims=True))
    a /= a.sum(1, keepdims=True)
    pooled = (a[:, None, :] @ states)[:, 0]
    logit = pooled @ p["out"] + p["bias"][0]
    return (logit, (states, a, pooled, saved)) if keep else logit


def backward(p: dict[str, np.ndarray], x: np.ndarray, rows: np.ndarray, kept, dlogit: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters and of the words' inputs."""
    states, a, pooled, saved = kept
    live = rows >= 0
    g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("chars", "words")}
    g["bias"][0] = dlogit.sum()
    g["out"] = pooled.T @ dlogit
    dp = dlogit[:, None] * p["out"]
    ds = a[:, :, None] * dp[:, None, :]
    da = np.einsum("nh,nth->nt", dp, states)
    de = a * (da - (a * da).sum(1, keepdims=True)) * live
    ds += de[:, :, None] * p["att"]
    g["att"] = np.einsum("nt,nth->h", de, states)
    dx = np.zeros_like(x)
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        wh = p[f"h{d}"]
        dh = np.zeros((len(rows), HIDDEN), np.float32)
        for t, h, z, r, c in reversed(saved[d]):
            m = live[:, t, None]
            dh = dh + ds[:, t, part]
            own = np.where(m, dh, 0)
            dz, dc = own * (c - h) * z * (1 - z), own * z * (1 - c * c)
            back = dc @ wh[:, 2 * HIDDEN :].T
            dr = back * h * r * (1 - r)
            da_ = np.concatenate([dz, dr, dc], 1)
            g[f"h{d}"][:, : 2 * HIDDEN] += h.T @ da_[:, : 2 * HIDDEN]
            g[f"h{d}"][:, 2 * HIDDEN :] += (r * h).T @ dc
            g[f"c{d}"] += da_.sum(0)
            at = rows[:, t]
            ok = at >= 0
            g[f"x{d}"] += x[at[ok]].T @ da_[ok]
            np.add.at(dx, at[ok], da_[ok] @ p[f"x{d}"].T)
            dh = np.where(m, dh - own * z + back * r + da_[:, : 2 * HIDDEN] @ wh[:, : 2 * HIDDEN].T, dh)
    return g, dx


class Model:
    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return _sigmoid(np.clip(self.slope * self.raw(Words(data, offs), self.gram, self.word) + self.shift, -60, 60))

    def raw(self, w: Words, gram: np.ndarray, word: np.ndarray) -> np.ndarray:
        x, _ = inputs(w, gram, word, self.p)
        rows, text = w.windows()
        logit = np.concatenate([forward(self.p, x, rows[i : i + 2048]) for i in range(0, len(rows), 2048)])
        out = np.full(len(w.first) - 1, -np.inf, np.float32)
        np.maximum.at(out, text, logit)
        return out

    def _ranks(self, docs: list[tuple]) -> list[np.ndarray]:
        """The log-odds of each document's windows; many documents at a time. docs: statistics, ``spelling``, word slots,
        windows."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(docs):
            j, n = i, 0
            while j < len(docs) and (j == i or n + len(docs[j][3]) <= 4096):
                n += len(docs[j][3])
                j += 1
            some, base, rows = docs[i:j], 0, []
            for d in some:
                rows.append(np.where(d[3] >= 0, d[3].astype(np.int64) + base, -1))
                base += len(d[0])
            vectors = np.concatenate([spelled(self.p["chars"], *d[1]) for d in some])
            x = np.concatenate([np.concatenate([d[0] for d in some]), vectors, self.p["words"][np.concatenate([d[2] for d in some])]], 1).astype(np.float32)
            rows = np.concatenate(rows)
            logit = np.concatenate([forward(self.p, x, rows[k : k + 2048]) for k in range(0, len(rows), 2048)])
            out += np.split(logit, np.cumsum([len(d[3]) for d in some])[:-1])
            i = j
        return out

    def fit(self, texts: list[str], y: np.ndarray, seed: int = 11, rounds: int = 6, batch: int = 128, statistics: bool = True) -> Model:
        """statistics: whether the network sees the n-grams' and words' statistics; without, it has only what it learns of their vectors."""
        r = np.random.default_rng(seed)
        half = np.zeros(len(texts), int)
        for k in (0, 1):
            of = r.permutation(np.flatnonzero(y == k))
            half[of[: len(of) // 2]] = 1

        def words(t: str) -> Words:
            raw = np.frombuffer(t.encode("utf-8", "replace"), np.uint8)
            return Words(raw, np.array([0, len(raw)]))

        halves = [(Table(GRAM_BITS), Table(WORD_BITS)) for _ in (0, 1)]
        for t, k, own in zip(texts, y.tolist(), half.tolist(), strict=True):
            w = words(t)
            halves[own][0].add(w.gram, k)
            halves[own][1].add(w.word, k)
        other = [tuple(t.close() for t in halves[1 - own]) for own in (0, 1)]
        for first, second in zip(*halves, strict=True):
            first.counts += second.counts
            first.docs += second.docs
        tables = [*other, tuple(t.close() for t in halves[0])]
        self.gram, self.word = (t * statistics for t in tables[2])
        p = self.p = start(r)
        # a window for training: distinct inputs are kept for each document, windows name them
        docs = []
        for t, own in zip(texts, half.tolist(), strict=True):
            w = words(t)
            x, ws = inputs(w, *tables[own], p)
            docs.append((x[:, :3] * statistics, spelling(w), ws, w.windows()[0].astype(np.int16 if len(w.word) < 1 << 15 else np.int32)))
        # every other window, and the last one, will do until the end
        every, docs = docs, [(*d[:3], d[3][np.unique(np.append(np.arange(0, len(d[3]), 2), len(d[3]) - 1))]) for d in docs]
        # at first a labelled document's windows with the strongest words stand for it
        chance = [np.where(d[3] >= 0, np.append(d[0].max(1) if len(d[0]) else [0.0], 0)[d[3]], 0) for d in docs]
        ranks = [np.sort(c, 1)[:, -2:].sum(1) for c in chance]
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        step = 0
        for turn in range(rounds):
            chosen: list[tuple[int, int]] = []
            for k, rank in enumerate(ranks):
                top = int(rank.argmax())
                chosen.append((k, top))
                if not y[k]:
                    chosen += [(k, int(i)) for i in r.integers(0, len(rank), 2)]
            weights = np.where(y == 1, len(chosen) / 2 / max(y.sum(), 1), len(chosen) / 2 / max(len(chosen) - y.sum(), 1))
            goal = -(-1200 // batch) if len(chosen) < 1200 else -(-len(chosen) // batch)
            order = np.concatenate([r.permutation(len(chosen)) for _ in range(-(-goal * batch // len(chosen)))])[: goal * batch]
            for s in range(0, len(order), batch):
                some = [chosen[i] for i in order[s : s + batch]]
                stats, cs, shares, many, ws, rows = [], [], [], [], [], np.full((len(some), WINDOW), -1, np.int64)
                base = 0
                for q, (k, i) in enumerate(some):
                    x3, (slots, first, share), own_ws, windows = docs[k]
                    row = windows[i]
                    used, back = np.unique(row[row >= 0], return_inverse=True)
                    rows[q, : len(back)] = back + base
                    base += len(used)
                    stats.append(x3[used])
                    spans = [slice(first[u], first[u + 1]) for u in used.tolist()]
                    cs += [slots[x] for x in spans]
                    shares += [share[x] for x in spans]
                    many.append(first[used + 1] - first[used])
                    ws.append(own_ws[used])
                cs, shares = (np.concatenate(cs).astype(np.int64), np.concatenate(shares)) if cs else (np.zeros(0, np.int64), np.zeros(0, np.float32))
                ws, many = np.concatenate(ws), np.concatenate(many)
                ends = np.concatenate([[0], np.cumsum(many)])
                x = np.concatenate([np.concatenate(stats), spelled(p["chars"], cs, ends, shares), p["words"][ws]], 1).astype(np.float32)
                t = np.array([y[k] for k, _ in some], np.float32)
                wt = np.array([weights[k] for k, _ in some], np.float32)
                logit, kept = forward(p, x, rows, True)
                g, dx = backward(p, x, rows, kept, (wt * (_sigmoid(logit) - t) / len(some)).astype(np.float32))
                by_gram = np.repeat(dx[:, 3 : 3 + CHAR_DIM], many, axis=0) * shares[:, None]
                for name, slots, grad in (("chars", cs, by_gram), ("words", ws, dx[:, 3 + CHAR_DIM :])):
                    used, back = np.unique(slots, return_inverse=True)
                    sums = np.stack([np.bincount(back, grad[:, j], len(used)) for j in range(grad.shape[1])], 1).astype(np.float32)
                    seen = moments[name][0]
                    seen[used] += sums * sums
                    p[name][used] -= 0.05 * sums / (np.sqrt(seen[used]) + 1e-6) + 1e-4 * p[name][used]
                step += 1
                rate = 0.02 * (0.5 ** (turn // 2))
                for name, grad in g.items():
                    m, v = moments[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
            # which window of a labelled document has the label is asked after each round, which others come near it less often
            again = [k for k in range(len(docs)) if y[k] or turn in (0, 2)]
            for k, rank in zip(again, self._ranks([docs[k] for k in again]), strict=True):
                ranks[k] = rank
        ranks = self._ranks(every)
        self.slope, self.shift = logistic(np.array([v.max() for v in ranks], float), y.astype(float))
        return self


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out rows are never read."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("o", F.md5(F.col("doc_id").cast("string").cast("binary")))
    with temporary() as put:
        pool = put(known.join(own.select("doc_id").where("doc_id is not null").distinct(), "doc_id"), "toxic-labelled")
        # these are at most MAX_EACH rows, so they may be broadcast to the documents
        some = [first_of(pool.where(f"y = {k}"), MAX_EACH[k]) for k in (1, 0)]
        found = own.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").groupBy("doc_id", "o", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
        found = put(found.withColumn("size", F.length("text")), "toxic-texts")
        upto = F.sum("size").over(Window.orderBy("o", "doc_id"))
        rows = found.join(F.broadcast(found.select("o", "doc_id", "size").withColumn("upto", upto).select("doc_id", "upto")), "doc_id").where(F.col("upto") <= MAX_CHARS).orderBy("o", "doc_id").select("text", "y").collect()
    y = np.array([r["y"] for r in rows], int)
    model = Model().fit([r["text"] for r in rows], y) if len(y) and 0 < y.sum() < len(y) else None
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j, d, o in blocks(data, offs):
                s = (m.score(d, o) if m else np.full(j - i, 0.5)).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = own.mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", "predicted")
