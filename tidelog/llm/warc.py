"""WARC derivatives: from each response record a linked metadata record and a plain-text conversion record.

A metadata record tells the source's header lines, its HTTP status and headers, its digests, the page's title, meta elements and
links, and names its conversion. A conversion record holds the page's visible text, a line for each block. Both refer to the
source by its record id and keep its target, date, and digests; their own ids follow from the source's id, so reruns agree.

Defined cases: responses that are no HTTP message, or whose status isn't 2xx, get a metadata record only; so do those whose type is
neither HTML nor plain text. Records of other kinds, and what is no record, yield nothing. A null page is a response with an empty body.
Unknown character sets are read as UTF-8, what can't be decoded as U+FFFD. Control characters in header values, line breaks among them,
are percent-encoded, and blanks at their ends too, so that any url gives a record that is read back as it was written. Repeated rows yield repeated records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, ship
from .html_dom import Page

VERSION = "WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
Headers = list[tuple[str, str]]


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def get(headers: Headers, name: str) -> str | None:
    return next((v for k, v in headers if k.lower() == name.lower()), None)


def safe(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]|^\s|\s$", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), value)


def record(headers: Headers, block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {safe(v)}" for k, v in headers if k.lower() != "content-length"), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _lines(raw: bytes) -> Headers:
    out: Headers = []
    for line in raw.decode("utf-8", "surrogateescape").split("\n"):
        line = line.rstrip("\r")
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _split(raw: bytes) -> tuple[bytes, bytes, bytes]:
    """First line, other header bytes, body."""
    m = re.search(rb"\r?\n\r?\n", raw)
    head, body = (raw[: m.start()], raw[m.end() :]) if m else (raw, b"")
    first, _, rest = head.partition(b"\n")
    return first.rstrip(b"\r"), rest, body


def parse(raw: bytes | None) -> tuple[Headers, bytes] | None:
    """Header lines and block of a record; None if it is none, or shorter than it says."""
    if not raw or not raw.lstrip(b"\r\n").startswith(b"WARC/"):
        return None
    _, head, body = _split(raw.lstrip(b"\r\n"))
    headers = _lines(head)
    size = get(headers, "Content-Length") or ""
    return (headers, body[: int(size)]) if size.isdigit() and len(body) >= int(size) else None


def response(uri: str, body: bytes, name: str, date: str = DATE) -> bytes:
    """The response record of a page that was fetched as HTML."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    return record(
        [
            ("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", date), ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response"),
        ],
        http,
    )


def _dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while (m := re.compile(rb"([0-9a-fA-F]+)[^\n]*\n").match(body, at)) and int(m[1], 16):
        out.append(body[m.end() : m.end() + int(m[1], 16)])
        at = m.end() + int(m[1], 16) + 2
    return b"".join(out)


def payload(http: Headers, body: bytes) -> bytes:
    """The body without its transfer and content encodings; as it is where they are broken."""
    if "chunked" in (get(http, "Transfer-Encoding") or "").lower():
        body = _dechunk(body)
    kind = (get(http, "Content-Encoding") or "").lower()
    try:
        return gzip.decompress(body) if "gzip" in kind else zlib.decompress(body) if "deflate" in kind else body
    except (OSError, EOFError, zlib.error):
        return body


def decoded(http: Headers, body: bytes) -> str:
    """The body as text, by the character set of the HTTP header or of a meta element in the whole head."""
    m = re.search(r"charset=[\"']?([\w.:-]+)", get(http, "Content-Type") or "", re.I)
    if not m:
        end = re.search(rb"</head|<body", body, re.I)
        m = re.search(r"<meta[^>]+charset=[\"']?([\w.:-]+)", body[: end.start() if end else len(body)].decode("latin-1"), re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_META = re.compile(r"<meta\s([^>]*)>", re.I)
_LINK = re.compile(r"<(a|area|link|img|script|iframe|form)\s([^>]*)>", re.I)
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def _attrs(text: str) -> dict[str, str]:
    import html

    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(text)}


def page_facts(source: str) -> dict:
    import html

    visible = re.sub(r"<!--.*?-->", "", source, flags=re.S)
    title = _TITLE.search(visible)
    links = []
    for tag, attrs in _LINK.findall(visible):
        a = _attrs(attrs)
        if url := a.get("href") or a.get("src") or a.get("action"):
            links.append({"path": f"{tag.upper()}@/{'href' if 'href' in a else 'src' if 'src' in a else 'action'}", "url": url})
    return {"title": " ".join(html.unescape(title[1]).split()) if title else None, "metas": [_attrs(m) for m in _META.findall(visible)], "links": links}


def derive(raw: bytes | None) -> list[tuple[Headers, bytes]]:
    """The derived records of a source record: metadata and, for pages, conversion."""
    found = parse(raw)
    if not found or (get(found[0], "WARC-Type") or "").lower() != "response":
        return []
    source, block = found
    name = get(source, "WARC-Record-ID") or f"<urn:sha1:{digest(block)}>"
    ids = {k: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{k}')}>" for k in ("metadata", "conversion")}
    first, head, body = _split(block)
    http = _lines(head)
    status = re.match(rb"HTTP/\S+\s+(\d+)\s*(.*)", first)
    plain = payload(http, body) if status else b""
    kind = (get(http, "Content-Type") or "").split(";")[0].strip().lower()
    shared: Headers = [(k, v) for k in ("WARC-Target-URI", "WARC-Date", "WARC-IP-Address") if (v := get(source, k)) is not None]
    refers: Headers = [("WARC-Refers-To", name), *[(f"WARC-Refers-To-{k[5:]}", v) for k, v in shared if k != "WARC-IP-Address"]]
    facts: dict = {
        "source": {"headers": dict(source), "block_digest": get(source, "WARC-Block-Digest") or digest(block), "payload_digest": get(source, "WARC-Payload-Digest") or digest(body), "length": len(block)},
        "http": {"status": int(status[1]), "reason": status[2].decode("latin-1"), "headers": dict(http), "entity_length": len(body)} if status else None,
    }
    out = []
    if status and 200 <= int(status[1]) < 300 and kind in ("text/html", "application/xhtml+xml", "text/plain"):
        text = decoded(http, plain)
        if kind != "text/plain":
            facts["html"] = page_facts(text)
            text = Page(text).lines()
        said = text.encode("utf-8", "surrogatepass")
        facts["conversion"] = {"record_id": ids["conversion"], "digest": digest(said), "length": len(said)}
        out.append(([("WARC-Type", "conversion"), ("WARC-Record-ID", ids["conversion"]), *shared, *refers, ("WARC-Source-Payload-Digest", facts["source"]["payload_digest"]), ("WARC-Block-Digest", digest(said)), ("Content-Type", "text/plain; charset=utf-8")], said))
    told = json.dumps(facts, ensure_ascii=False, sort_keys=True).encode("utf-8", "surrogateescape")
    meta: Headers = [("WARC-Type", "metadata"), ("WARC-Record-ID", ids["metadata"]), *shared, *refers, *([("WARC-Concurrent-To", ids["conversion"])] if out else []), ("WARC-Source-Payload-Digest", facts["source"]["payload_digest"]), ("WARC-Block-Digest", digest(told)), ("Content-Type", "application/json")]
    return [(meta, told), *out]


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """page_id, record: each page as a response record."""
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [response(u or "", (h or "").encode("utf-8", "surrogatepass"), f"{u}#{i}", date) for i, u, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], ["page_id", "record"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, record binary")


FIELDS = ("warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "block_digest", "source_digest", "content_type")
_NAMES = ("WARC-Type", "WARC-Record-ID", "WARC-Refers-To", "WARC-Concurrent-To", "WARC-Target-URI", "WARC-Date", "WARC-Block-Digest", "WARC-Source-Payload-Digest", "Content-Type")


def derivatives(records: DataFrame, id_col: str = "page_id", record_col: str = "record", with_record: bool = True) -> DataFrame:
    """For each source record its derived ones: the id column, the header fields, n_bytes, content (the block as text), and record."""
    ship(records.sparkSession)
    kind = records.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                b = batch.slice(s, 500)
                ids, cols = [], [[] for _ in range(len(FIELDS) + 2 + with_record)]
                for k, raw in enumerate(b.column(1).to_pylist()):
                    for headers, block in derive(raw):
                        ids.append(k)
                        row = [*(get(headers, n) for n in _NAMES), len(block), block.decode("utf-8", "replace"), *([record(headers, block)] if with_record else [])]
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                types = [pa.string()] * len(FIELDS) + [pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), *[pa.array(c, t) for c, t in zip(cols, types, strict=False)]], ["page_id", *FIELDS, "n_bytes", "content", *(["record"] if with_record else [])])

    rows = records.select(F.col(id_col).alias("page_id"), F.col(record_col).alias("record"))
    return rows.mapInArrow(run, f"page_id {kind}, {', '.join(f'{f} string' for f in FIELDS)}, n_bytes long, content string" + (", record binary" if with_record else ""))


def write_files(records: DataFrame, folder: str, record_col: str = "record") -> DataFrame:
    """Writes records as files of one gzip member each, one file for each task; returns path, n_records. A file's name is unique to the
    attempt that writes it, so only the files that are returned count."""
    ship(records.sparkSession)

    def run(batches):
        import pyarrow as pa

        out, n, path = None, 0, f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            for raw in b.column(0).to_pylist():
                if raw is None:
                    continue
                if out is None:
                    fs, inner = filesystem(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(inner, compression=None)
                out.write(gzip.compress(raw, 6, mtime=0))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64())})

    return records.select(F.col(record_col).alias("record")).mapInArrow(run, "path string, n_records long")


def iterate(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of a WARC file, plain or gzipped by record or as a whole, holding one record at a time."""

    def plain() -> Iterator[bytes]:
        first = stream.read(2)
        if first != b"\x1f\x8b":
            yield first
            while data := stream.read(chunk):
                yield data
            return
        d, data = zlib.decompressobj(31), first
        while data or (data := stream.read(chunk)):
            yield d.decompress(data)
            data = d.unused_data
            if d.eof:
                d = zlib.decompressobj(31)

    source = plain()
    held, ended = b"", False
    while True:
        held = held.lstrip(b"\r\n")
        while (m := re.search(rb"\r?\n\r?\n", held)) is None and not ended:
            more = next(source, None)
            ended, held = more is None, (held + (more or b"")).lstrip(b"\r\n")
        if m is None:
            return
        size = get(_lines(held[: m.start()].partition(b"\n")[2]), "Content-Length") or "0"
        end = m.end() + (int(size) if size.isdigit() else 0)
        parts, have = [held], len(held)
        while have < end and not ended:
            more = next(source, None)
            ended = more is None
            if more:
                parts.append(more)
                have += len(more)
        held = b"".join(parts)
        yield held[:end]
        held = held[end:]


def read_files(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """path, position (number of the record in its file), record of WARC files; a file is read by one task, record by record."""
    ship(spark)
    files = paths.select("path") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "path string")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, inner = filesystem(path)
                with fs.open_input_stream(inner, compression=None) as stream:
                    for k, raw in enumerate(iterate(stream)):
                        yield pa.RecordBatch.from_pydict({"path": [path], "position": pa.array([k], pa.int64()), "record": pa.array([raw], pa.binary())})

    return files.repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, "path string, position long, record binary")
