"""Operator 7: WARC archives with a two-level capture index.

Archives are written by tasks, one gzip member per record, into the shared folder. The index has a line
per record: reversed-host URL key, record id, archive, offset, length. Its lines are sorted by key over all
tasks and cut into blocks of ``BLOCK_LINES`` that are compressed one by one; each index file has a sparse
directory beside it with the first key and the place of each of its blocks. A lookup is sent to the index files
whose range holds its key, finds its block by binary search in the directory, reads that range, finds its
lines by binary search in the block, and reads the ranges of the records. The driver holds a row for each
index file at most, and a URL that many records share has its lines in several of them.

Records with equal payloads: the one with the least id is a response, the others are revisits of it.
Equal payloads meet by digest in a join that Spark may split, and payloads move once.

Defined cases: a null payload is an empty one; a null URL has no target URI and the key ``-``; rows that
repeat id and payload are archived as often as they occur, all as response if the id is the least; a row
with a null id is archived with id ``null`` and never revisited; ties of keys are ordered by record id;
payloads of any length are streamed record by record; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import in_python, saved, shared_dir

BLOCK_LINES = 1024
#: Records that a lookup reads together, in the order of their places in the archives.
READ_LINES = 1024
#: Names and line ends of the WARC 1.1 format.
VERSION, CRLF = "WARC/1.1", b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
RECORD = "urn:page:"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def url_key(url: str | None) -> str:
    """Host reversed label by label, then port, path and query; one line without blanks."""
    if url is None or "://" not in url:
        return quote(url, safe="/:?#&=%") if url else "-"
    rest = url.partition("://")[2]
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, _, port = rest[:cut].lower().partition(":")
    return quote(",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (rest[cut:] or "/"), safe="/:?#&=%,)")


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit carries headers and the digest, not the payload."""
    block = HTTP + payload if refers_to is None else HTTP
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{RECORD}{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{RECORD}{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)).encode() + CRLF
    return gzip.compress(head + block + CRLF + CRLF, 6, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and HTTP body of one gzip member."""
    plain = gzip.decompress(data)
    head, _, rest = plain.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(CRLF + CRLF)[2]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class _Ranges:
    """Reads of byte ranges; the files read last stay open."""

    MOST = 16

    def __init__(self):
        self.open: dict[str, pa.NativeFile] = {}

    def read(self, uri: str, offset: int, length: int) -> bytes:
        file = self.open.pop(uri, None)
        if file is None:
            fs, path = _open(uri)
            file = fs.open_input_file(path)
            if len(self.open) >= self.MOST:
                self.open.pop(next(iter(self.open))).close()
        self.open[uri] = file  # the last one in order of use
        return file.read_at(length, offset)

    def close(self) -> None:
        for file in self.open.values():
            file.close()


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write archives into ``folder``; returns their records (key, record_id, archive, offset, length), saved.

    Payloads under ``least_bytes`` are never revisits. A task that runs twice writes under another name, and
    only the records that its last run returned are in the result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    enough = F.octet_length("payload") >= least_bytes
    first = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).where(enough)
    first = first.groupBy(F.unhex(F.sha1("payload")).alias("digest")).agg(F.min("id").alias("first"))
    # One row per digest on the right, so Spark can split a digest that a large share of the pages has.
    linked = rows.join(first, "digest", "left").withColumn("refers_to", F.when(enough & (F.col("first") != F.col("id")), F.col("first")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            out = []
            for i, url, payload, digest, refers_to in zip(batch["id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"]):
                if file is None:
                    fs, path = _open(uri)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    file = fs.open_output_stream(path, compression=None)
                record_id = "null" if pd.isna(i) else str(int(i))
                data = record_bytes(record_id, url, payload, base64.b32encode(digest).decode(), None if pd.isna(refers_to) else str(int(refers_to)))
                file.write(data)
                out.append((url_key(url), record_id, uri, offset, len(data)))
                offset += len(data)
            yield pd.DataFrame(out, columns=["key", "record_id", "archive", "offset", "length"])
        if file is not None:
            file.close()

    fields = linked.select("id", "url", "payload", "digest", "refers_to")
    return saved(in_python(fields, run, "key string, record_id string, archive string, offset long, length long"))


def build_index(records: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted index in compressed blocks, with a directory for each file; returns the files (first_key, last_key, file, n), saved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uri, file, offset = f"{folder}/{uuid.uuid4().hex}.cdx", None, 0
        held: list[tuple] = []
        places: list[list] = []  # first key, last key, offset and length of each block

        def block():
            nonlocal file, offset
            if file is None:
                fs, path = _open(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                file = fs.open_output_stream(path, compression=None)
            part, held[:] = held[:lines], held[lines:]
            data = zlib.compress("\n".join(f"{key} {json.dumps(rest)}" for key, *rest in part).encode(), 6)
            file.write(data)
            places.append([part[0][0], part[-1][0], offset, len(data)])
            offset += len(data)

        n = 0
        for batch in batches:
            held += batch[["key", "record_id", "archive", "offset", "length"]].itertuples(index=False, name=None)
            n += len(batch)
            while len(held) >= lines:
                block()
        if held:
            block()
        if file is not None:
            file.close()
            fs, path = _open(uri + ".dir")
            with fs.open_output_stream(path, compression=None) as out:
                out.write(zlib.compress(json.dumps(places).encode(), 6))
            yield pd.DataFrame([(places[0][0], places[-1][1], uri, n)], columns=["first_key", "last_key", "file", "n"])

    ordered = records.repartitionByRange("key", "record_id").sortWithinPartitions("key", "record_id")
    return saved(in_python(ordered, run, "first_key string, last_key string, file string, n long"))


def directory_of(file: str) -> list[list]:
    """[first key, last key, offset, length] of the blocks of an index file, in order."""
    fs, path = _open(file + ".dir")
    with fs.open_input_stream(path, compression=None) as f:
        return json.loads(zlib.decompress(f.read()))


def block_lines(ranges: _Ranges, file: str, offset: int, length: int) -> list[tuple[str, list]]:
    """(key, [record id, archive, offset, length]) of a block, sorted by key."""
    text = zlib.decompress(ranges.read(file, offset, length)).decode()
    return [(key, json.loads(rest)) for key, _, rest in (line.partition(" ") for line in text.split("\n"))]


def _read(ranges: _Ranges, key: str, place: list) -> tuple:
    fields, body = parse_record(ranges.read(place[1], place[2], place[3]))
    record_id = fields["WARC-Record-ID"][1:-1].removeprefix(RECORD)
    refers_to = fields.get("WARC-Refers-To", "<>")[1:-1].removeprefix(RECORD)
    kind = fields["WARC-Type"]
    digest = payload_digest(body) if kind == "response" else fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = len(body) if kind == "response" else int(fields["X-Payload-Length"])
    return key, None if record_id == "null" else int(record_id), size, digest, kind, int(refers_to) if refers_to else None, body if kind == "response" else None


_COLUMNS = ["key", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
_SCHEMA = "key string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _frame(rows: list[tuple], payloads: bool) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_COLUMNS)
    for c in ("page_id", "refers_to"):
        out[c] = out[c].astype("Int64")
    return out if payloads else out.drop(columns="payload")


def read_all(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record that the index knows, block by block; archives are read in the order of their offsets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges = _Ranges()
        for batch in batches:
            for file in batch["file"]:
                for *_, offset, length in directory_of(file):
                    yield from _records(ranges, block_lines(ranges, file, offset, length), payloads)
        ranges.close()

    dealt = files.select("file").repartition(files.sparkSession.sparkContext.defaultParallelism)
    return in_python(dealt, run, _SCHEMA + (", payload binary" if payloads else ""))


def _records(ranges: _Ranges, lines: list[tuple[str, list]], payloads: bool) -> Iterator[pd.DataFrame]:
    lines = sorted(lines, key=lambda x: x[1][1:])
    for at in range(0, len(lines), 64):
        yield _frame([_read(ranges, key, place) for key, place in lines[at : at + 64]], payloads)


def lookup(files: DataFrame, urls: DataFrame, url_col: str = "url", payloads: bool = True) -> DataFrame:
    """The records of every distinct URL in ``urls``.

    Each key goes to the index files whose ranges may hold it. Keys arrive sorted by file, so a task opens one
    directory after another, and a block once for all its keys.
    """
    known = sorted(map(tuple, files.select("first_key", "last_key", "file").collect()))  # a row for each task that wrote the index
    firsts, lasts = [f for f, *_ in known], [last for _, last, _ in known]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = set(map(url_key, batch["url"]))
            out = [(k, i) for k in keys for i in range(bisect.bisect_left(lasts, k), bisect.bisect_right(firsts, k))]
            yield pd.DataFrame(out, columns=["key", "number"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranges, number, blocks_, at, found, keys, wanted = _Ranges(), None, [], None, [], [], []
        for batch in batches:
            for key, of in zip(batch["key"], batch["number"]):
                if of != number:
                    number, at = of, None
                    blocks_ = directory_of(known[of][2])
                    ends = [b[1] for b in blocks_]
                place = bisect.bisect_left(ends, key)
                while place < len(blocks_) and blocks_[place][0] <= key:
                    if place != at:
                        at, found = place, block_lines(ranges, known[of][2], *blocks_[place][2:])
                        keys = [k for k, _ in found]
                    wanted += found[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
                    place += 1
                    if len(wanted) >= READ_LINES:
                        yield from _records(ranges, wanted, payloads)
                        wanted = []
        yield from _records(ranges, wanted, payloads)
        ranges.close()

    wanted = in_python(urls.select(F.col(url_col).alias("url")), route, "key string, number int").distinct()
    # Numbered, so that the tasks are as many as asked for: each reads archives, however small the keys are.
    tasks = max(len(known), wanted.sparkSession.sparkContext.defaultParallelism)
    dealt = wanted.repartitionByRange(tasks, "number", "key").sortWithinPartitions("number", "key")
    return in_python(dealt, run, _SCHEMA + (", payload binary" if payloads else ""))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages, index them, and look the records of every page's URL up again."""
    folder = shared_dir(pages.sparkSession)
    files = build_index(write(pages, f"{folder}/archives", least_bytes=least_bytes), f"{folder}/index")
    return lookup(files, pages, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
