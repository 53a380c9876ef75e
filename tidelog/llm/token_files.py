"""Token ids in fixed-width bit-packed files.

Every id takes ``width`` bits, the least that hold the vocabulary; blocks of ``BLOCK_IDS`` ids start at whole bytes and their
byte offsets are stored, so any range of ids is read and unpacked by numpy without what stands before it. A file:

    space    64 zero bytes
    blocks   packed ids, lowest bits first
    offsets  8 bytes for each block, and the end
    index    for each document its id, whether it has one, and the position of its first id; then the number of ids
    trailer  64 bytes: magic, version, width, ids a block, documents, ids, positions of the two tables

Documents are range-partitioned by id, so the files in order of their first document hold all documents in ascending order. A
file's name is unique to the task attempt that writes it and only finished attempts are listed: a lost executor leaves at most an
unlisted file.

Defined cases: a null text is encoded as the empty text; documents without id come first; rows of equal id follow in order of
their text; an empty table gives no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import blocks, buffers, word_bounds, word_hashes
from .common import filesystem, save, scratch, ship

MAGIC, VERSION, HEADER = b"TIDEBITS", 1, struct.Struct("<8sIIIIQQQQ8x")
BLOCK_IDS = 1 << 16
#: Text bytes for each file.
FILE_BYTES = 24 << 20
#: A tokenizer's definition is sent to all executors only up to this size.
MAX_TOKENIZER_BYTES = 64 << 20
#: Distinct words whose ids a worker remembers; the memory is emptied when full, which changes no result.
MEMO_WORDS = 1_500_000


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """``width`` bits an id, lowest first, filled up to whole bytes."""
    ids = np.asarray(ids, np.uint32)
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int, skip: int = 0) -> np.ndarray:
    """``count`` ids after the first ``skip`` of the packed bytes."""
    raw = np.frombuffer(data, np.uint8)
    if width in (8, 16, 32):
        return raw[: len(raw) // (width // 8) * (width // 8)].view(f"<u{width // 8}")[skip : skip + count].astype(np.uint32)
    at = np.arange(skip, skip + count, dtype=np.int64) * width
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    value = np.zeros(count, np.uint64)
    for k in range(5):
        value |= padded[(at >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Writer:
    """Writes one file; holds one block of ids and the index."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path)
        self.width, self.at, self.offsets, self.ids, self.valid, self.starts = width, HEADER.size, [], [], [], [0]
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.out.write(bytes(HEADER.size))

    def _flush(self, last: bool) -> None:
        if not self.held:
            return
        ids = np.concatenate(self.rest)
        n = len(ids) if last else len(ids) // BLOCK_IDS * BLOCK_IDS
        for i in range(0, n, BLOCK_IDS):
            raw = pack(ids[i : min(i + BLOCK_IDS, n)], self.width)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.rest = [ids[n:]]
        self.held = len(ids) - n

    def add(self, doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents in order: their ids one after another, and how many each has."""
        self.ids += [0 if d is None else d for d in doc_ids]
        self.valid += [d is not None for d in doc_ids]
        self.starts += (self.total + np.cumsum(counts)).tolist()
        self.total = self.starts[-1]
        self.rest.append(np.asarray(ids, np.uint32))
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self._flush(False)

    def close(self) -> None:
        """The trailer comes last, as a store may not let the beginning be written again."""
        self._flush(True)
        table = self.at
        self.out.write(np.array([*self.offsets, self.at], "<u8").tobytes())
        index = table + 8 * (len(self.offsets) + 1)
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.valid, "u1").tobytes() + np.array(self.starts, "<u8").tobytes())
        self.out.write(HEADER.pack(MAGIC, VERSION, self.width, BLOCK_IDS, 0, len(self.ids), self.total, table, index))
        self.out.close()


class Reader:
    """Random access to one file's documents."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, version, self.width, self.block, _, self.n, self.total, table, index = HEADER.unpack(self.file.read_at(HEADER.size, size - HEADER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no token file of version {VERSION}")
        self.offsets = np.frombuffer(self.file.read_at(index - table, table), "<u8").astype(np.int64)
        raw = self.file.read_at(17 * self.n + 8, index)
        self.ids = np.frombuffer(raw, "<i8", self.n)
        self.valid = np.frombuffer(raw, "u1", self.n, 8 * self.n).astype(bool)
        self.starts = np.frombuffer(raw, "<u8", self.n + 1, 9 * self.n).astype(np.int64)

    def range(self, a: int, b: int) -> np.ndarray:
        """The file's ids from a up to b."""
        if a >= b:
            return np.zeros(0, np.uint32)
        i, j = a // self.block, (b - 1) // self.block + 1
        raw = self.file.read_at(int(self.offsets[j] - self.offsets[i]), int(self.offsets[i]))
        return unpack(raw, self.width, b - a, a - i * self.block)

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.starts[k]), int(self.starts[k + 1]))

    def documents(self, ids_at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, position of its first id, ids) of all documents, reading runs of about so many ids."""
        k = 0
        while k < self.n:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + ids_at_once, "right")) - 1)
            run = self.range(int(self.starts[k]), int(self.starts[j]))
            for d in range(k, j):
                a = int(self.starts[d] - self.starts[k])
                yield (int(self.ids[d]) if self.valid[d] else None), int(self.starts[d]), run[a : a + int(self.starts[d + 1] - self.starts[d])]
            k = j


#: The pattern that ``WordCoder`` knows how to split texts for.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTER, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SYMBOL[33:127] = True
_SYMBOL[48:58] = False
_SYMBOL[39] = False
_SYMBOL &= ~_LETTER


class WordCoder:
    """Encodes texts with a tokenizer of the tokenizers library that lower-cases, drops white space and splits by ``PIECES``, so
    that a text's ids are those of its pieces one after another. Pieces here are words, cut between an ASCII letter and an ASCII
    symbol other than the apostrophe. Each distinct piece is encoded once by the library and then found by its 64-bit hash."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        """Memory: hashes in order with the place and number of their ids in the pool, some 20 bytes a piece; the latest apart."""
        self.hashes, self.starts, self.lens = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint16)
        self.new: dict[int, tuple[int, int]] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _settle(self) -> None:
        """Puts the latest pieces in order with the others."""
        fresh = np.fromiter(self.new, np.uint64, len(self.new))
        place = np.array(list(self.new.values()), np.int64).reshape(-1, 2)
        order = np.argsort(fresh)
        at = np.searchsorted(self.hashes, fresh[order])
        self.hashes = np.insert(self.hashes, at, fresh[order])
        self.starts = np.insert(self.starts, at, place[order, 0].astype(np.uint32))
        self.lens = np.insert(self.lens, at, place[order, 1].astype(np.uint16))
        self.new = {}

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids of each hash; -1 if it isn't known."""
        starts, lens = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            starts[known], lens[known] = self.starts[at[known]], self.lens[at[known]]
        if self.new:
            rest = np.flatnonzero(starts < 0)
            found = [self.new.get(h, (-1, 0)) for h in hashes[rest].tolist()]
            if found:
                starts[rest], lens[rest] = np.array(found, np.int64).T
        return starts, lens

    @staticmethod
    def fits(definition: str) -> bool:
        """Whether pieces can be encoded alone: the normalisers and splits are known ones and nothing is added at a text's ends."""
        d = json.loads(definition)
        normal, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
        kinds = [x.get("type") for x in normal.get("normalizers", [])]
        split = (pre.get("pretokenizers") or [{}])[0]
        known = split.get("pattern") == {"Regex": PIECES} and split.get("behavior") == "Removed" and split.get("invert") is True
        raw = not any(t.get("normalized") for t in d.get("added_tokens", []))
        return kinds == ["NFC", "Replace", "Lowercase"] and known and raw and [x.get("use_regex") for x in pre["pretokenizers"][1:]] == [False] and d.get("post_processor") is None and d["model"].get("dropout") is None

    def _learn(self, hashes: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, lens = [], np.zeros(len(words), np.int64)
        for i in range(0, len(words), 2000):
            e = self.tokenizer.encode(words[i : i + 2000], is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint32))
            if e.ids:
                lens[i : i + 2000] = np.bincount(e.word_ids, minlength=len(words[i : i + 2000]))
        found = np.concatenate(ids)
        starts = self.used + np.cumsum(lens) - lens
        while len(self.pool) < self.used + len(found) + 1:
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, np.uint32)])
        self.pool[self.used : self.used + len(found)] = found
        self.used += len(found)
        short = lens < 1 << 16  # longer pieces are encoded anew each time
        self.new.update(zip(hashes[short].tolist(), zip(starts[short].tolist(), lens[short].tolist(), strict=True), strict=True))
        return starts, lens

    def encode(self, column, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first text, end, ids, ids a text) of runs of texts, each text with ``end_id`` at its end. Texts that hold an added token, in
        any case, are encoded whole: the library looks for these by rules of its own, and pieces are remembered without regard to case."""
        data, offs = buffers(column)
        for i, j, d, o in blocks(data, offs):
            raw = d.tobytes()
            folded = raw.lower()
            if not any(t in folded for t in self.added):
                yield i, j, *self._pieces(raw, d, o, end_id)
                continue
            for k in range(j - i):
                a, b = int(o[k]), int(o[k + 1])
                if any(t in folded[a:b] for t in self.added):
                    found = self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids
                    yield i + k, i + k + 1, np.array([*found, end_id], np.uint32), np.array([len(found) + 1])
                else:
                    yield i + k, i + k + 1, *self._pieces(raw[a:b], d[a:b], np.array([0, b - a]), end_id)

    def _pieces(self, raw: bytes, d: np.ndarray, o: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without added tokens, and how many each text has."""
        starts, ends, first = word_bounds(d, o)
        letter, symbol = _LETTER[d], _SYMBOL[d]
        cuts = np.flatnonzero(letter[:-1] & symbol[1:] | symbol[:-1] & letter[1:]) + 1
        cuts = np.setdiff1d(cuts, o, assume_unique=True)
        starts, ends = np.sort(np.concatenate([starts, cuts]), kind="stable"), np.sort(np.concatenate([ends, cuts]), kind="stable")
        first = np.searchsorted(starts, o, "left")
        hashes, some, back = np.unique(word_hashes(d, starts, ends, True), return_index=True, return_inverse=True)
        if len(self.hashes) + len(self.new) > MEMO_WORDS:
            self._forget()
        at, many = self._places(hashes)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new], many[new] = self._learn(hashes[new], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[some[new]].tolist(), ends[some[new]].tolist(), strict=True)])
            if len(self.new) > 50_000:
                self._settle()
        at, many = at[back], many[back]
        # every text's end is one more word, that of the end id
        n, texts = len(at), len(o) - 1
        lens, where = np.empty(n + texts, np.int64), np.empty(n + texts, np.int64)
        tail = first[1:] + np.arange(texts)
        body = np.ones(n + texts, bool)
        body[tail] = False
        lens[body], where[body] = many, at
        self.pool[self.used] = end_id
        lens[tail], where[tail] = 1, self.used
        upto = np.cumsum(lens)
        ids = self.pool[np.repeat(where - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)]
        return ids, np.diff(np.concatenate([[0], upto[tail]]))


class TextCoder:
    """Encodes whole texts; for tokenizers that ``WordCoder`` does not fit."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)

    def encode(self, column, end_id: int):
        texts = column.to_pylist()
        for i in range(0, len(texts), 64):
            some = [np.array([*e.ids, end_id], np.uint32) for e in self.tokenizer.encode_batch([t or "" for t in texts[i : i + 64]], add_special_tokens=False)]
            yield i, min(i + 64, len(texts)), np.concatenate(some), np.array([len(s) for s in some], np.int64)


_CODERS: dict[int, object] = {}


def coder(definition: str):
    """This worker's coder; it lives on through the worker's tasks."""
    key = zlib.crc32(definition.encode())
    if key not in _CODERS:
        _CODERS[key] = (WordCoder if WordCoder.fits(definition) else TextCoder)(definition)
    return _CODERS[key]


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files and returns their list: path, first_id, n_docs, n_ids, base (ids in all files before it)."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = f.read()
    if len(definition) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} has more than {MAX_TOKENIZER_BYTES} bytes")
    from tokenizers import Tokenizer

    width = width_of(max(Tokenizer.from_str(definition).get_vocab_size(with_added_tokens=True), end_id + 1))
    sent = spark.sparkContext.broadcast(definition)
    folder = folder or scratch(spark, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, -(-size // FILE_BYTES))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")

    def put(batches):
        import pyarrow as pa

        out, first, n_docs = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            if out is None:
                path = f"{folder}/ids-{uuid.uuid4().hex}.tok"
                out, first = Writer(path, width), ids[0]
            n_docs += len(ids)
            for i, j, tokens, counts in coder(sent.value).encode(b.column(1), end_id):
                out.add(ids[i:j], tokens, counts)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_id": pa.array([first], pa.int64()), "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([out.total], pa.int64())})

    files = rows.mapInArrow(put, "path string, first_id long, n_docs long, n_ids long")
    files = save(files.repartition(-(-n // 1000)), "token-files")  # a row for each file: no file of its own for each
    w = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))


def read(files: DataFrame) -> DataFrame:
    """Reads token files back: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def get(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = [(d, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in Reader(path).documents()]
                for i in range(0, len(found), 10_000):
                    cols = list(zip(*found[i : i + 10_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = files.select("path", "base").repartition(max(files.sparkSession.sparkContext.defaultParallelism, files.count() // 4, 1))
    return spread.mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, **columns) -> DataFrame:
    """Encodes ``docs`` into files and reads them back."""
    return read(write(docs, tokenizer_path, **columns))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))

