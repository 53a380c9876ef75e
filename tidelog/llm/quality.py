"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Every whole text gets a vector of statistics, transformed so that they lie near a normal distribution. Each class has a mean and
a covariance shrunk towards the pooled covariance and its diagonal; its Cholesky factor is computed once. A score is the logistic of the
difference of the two log-densities (Mahalanobis distances by triangular solves, log-determinants, priors), scaled on the training rows.

The classifier is fitted on at most MAX_TRAINING labelled documents, those first in order of the md5 of their id; of these only about as
many as are taken come to the driver. Statistics and scores cover every document. Label, language, source and id are never inputs.

Defined cases: null and empty texts get the statistics of an empty text; labels that are null, or of documents that are not there, are
left out, of several labels for one id the greatest counts, and of several rows of one id the one with the least statistics is fitted on; without training rows of both classes every score is 0.5; rows of
equal id are scored each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import blocks, buffers, word_bounds, word_hashes
from .common import save, ship, temporary

MAX_TRAINING = 20_000
_CLASS = np.full(256, 7, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[46, 44]] = 3
_CLASS[[ord(c) for c in "#*$%&|<>@^~=+\\{}[]_/"]] = 4
_CLASS[[33, 63, 58, 59, 34, 39, 40, 41, 45]] = 5
_CLASS[[32, 9, 10, 11, 12, 13]] = 6
NAMES = ("length", "words", "upper", "digit", "stop", "symbol", "mark", "space", "other", "word_mean", "word_sd", "word_max", "distinct", "top_word", "pairs", "again", "capital", "line_words", "line_sd", "line_distinct", "pipe", "bang", "short")


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row for each text."""
    n = len(offs) - 1
    out = np.zeros((n, len(NAMES)))
    starts, ends, first = word_bounds(data, offs)
    h = word_hashes(data, starts, ends, True)
    size = ends - starts
    kinds = _CLASS[data]
    for k in range(n):
        a, b = int(offs[k]), int(offs[k + 1])
        i, j = int(first[k]), int(first[k + 1])
        m, c = b - a, j - i
        if not c:
            continue
        share = np.bincount(kinds[a:b], minlength=8) / m
        w, s = h[i:j], size[i:j]
        _, times = np.unique(w, return_counts=True)
        pairs = len(np.unique(w[1:] ^ (w[:-1] << np.uint64(1)))) / (c - 1) if c > 1 else 1.0
        again = float((w[1:] == w[:-1]).mean()) if c > 1 else 0.0
        initial = data[starts[i:j]]
        breaks = np.flatnonzero(data[a:b] == 10) + a
        line = np.diff(np.concatenate(([i], np.searchsorted(starts[i:j], breaks) + i, [j])))
        line = line[line > 0]
        totals = np.concatenate(([0], np.cumsum(w, dtype=np.uint64)))
        edges = np.concatenate(([0], np.cumsum(line)))
        sums = totals[edges[1:]] - totals[edges[:-1]]
        out[k] = (
            np.log1p(m), np.log1p(c), *(share[[1, 2, 3, 4, 5, 6, 7]]), s.mean(), s.std(), s.max(), len(times) / c**0.9, times.max() / c, pairs, again,
            ((initial >= 65) & (initial <= 90)).mean(), np.log1p(line.mean()), np.log1p(line.std()), len(np.unique(sums)) / len(sums),
            (data[a:b] == 124).mean(), (data[a:b] == 33).mean(), (s <= 3).mean(),
        )
    fractions = [NAMES.index(x) for x in ("upper", "digit", "stop", "symbol", "mark", "other", "top_word", "again", "capital", "pipe", "bang")]
    out[:, fractions] = np.log(out[:, fractions] + 0.003)
    for x in ("word_mean", "word_sd", "word_max"):
        out[:, NAMES.index(x)] = np.log1p(out[:, NAMES.index(x)])
    return out


def logistic(q: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make q a log-odds of y: Newton steps with halving, towards targets a little inside 0 and 1."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    at = np.array([1.0, 0.0])
    z = np.stack([q, np.ones_like(q)], 1)
    loss = lambda v: float((np.logaddexp(0, z @ v) - target * (z @ v)).sum() + 1e-3 * (v @ v))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -60, 60)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 2e-3 * np.eye(2), z.T @ (p - target) + 2e-3 * at)
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return float(at[0]), float(at[1])


class Discriminant:
    def __init__(self, shrink: float = 0.15, spread: float = 0.1):
        self.shrink, self.spread = shrink, spread

    def fit(self, x: np.ndarray, y: np.ndarray) -> Discriminant:
        self.center, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.center) / self.scale
        parts = [z[y == k] for k in (0, 1)]
        own = [np.cov(p.T, bias=True) if len(p) > 1 else np.eye(z.shape[1]) for p in parts]
        pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
        self.means, self.factors, self.dets = [p.mean(0) for p in parts], [], []
        for p, c in zip(parts, own, strict=True):
            lam = max(self.shrink, z.shape[1] / (z.shape[1] + len(p)))
            c = (1 - lam) * c + lam * pooled
            c = (1 - self.spread) * c + self.spread * np.diag(np.maximum(np.diag(c), 0.05))
            f = np.linalg.cholesky(c + 1e-4 * np.eye(len(c)))
            self.factors.append(np.linalg.inv(f))
            self.dets.append(2 * np.log(np.diag(f)).sum())
        self.prior = float(np.log(len(parts[1]) / len(parts[0])))
        d = self.margin(x)
        self.unit = float(np.median(np.abs(d))) + 1e-9
        self.slope, self.shift = logistic(self._scaled(d), y)
        return self

    def _scaled(self, d: np.ndarray) -> np.ndarray:
        return np.clip(d / self.unit, -3, 3)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        d = [(((z - m) @ f.T) ** 2).sum(1) + t for m, f, t in zip(self.means, self.factors, self.dets, strict=True)]
        return (d[0] - d[1]) / 2 + self.prior

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self._scaled(self.margin(x)) + self.shift, -60, 60)))


def held_out(doc_id, modulus: int, remainder: int):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def first_of(pool: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows by o, a hash in hex digits. By the number of rows a bound is set that some more rows than these lie below, so that
    each task sends few rows to the driver, however many there are."""
    n = pool.count()
    wanted = most + 6 * most**0.5
    if n > wanted:
        pool = pool.where(F.substring("o", 1, 12) < f"{int(wanted / n * 16**12):012x}")
    return pool.orderBy("o", "doc_id").limit(most)


def classified(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels of held-out rows are never read."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def measure(batches):
        import pyarrow as pa

        for b in batches:
            data, offs = buffers(b.column(1))
            for i, j, d, o in blocks(data, offs):
                x = statistics(d, o).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))], ["doc_id", "x"])

    own = save(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(measure, f"doc_id {kind}, x array<float>"), "quality")
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), modulus, remainder))
    known = known.join(own, "doc_id").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x"))
    with temporary() as put:
        pool = put(known.withColumn("o", F.md5(F.col("doc_id").cast("string").cast("binary"))), "quality-labelled")
        rows = first_of(pool, MAX_TRAINING).select("x", "y").collect()
    y = np.array([r["y"] for r in rows])
    model = Discriminant().fit(np.array([r["x"] for r in rows], float), (y > 0).astype(int)) if min((y > 0).sum(), (y <= 0).sum()) > 0 else None

    def score(batches):
        import pyarrow as pa

        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, len(NAMES)).astype(float)
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = own.mapInArrow(score, f"doc_id {kind}, score double, predicted int")
    return out.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", "predicted")
