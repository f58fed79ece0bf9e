"""WARC archives and their records as a chunked table (operator 9).

Writing: payloads are cut into chunks of at most ``CHUNK`` bytes before they leave the JVM, which holds
a record once, as the cell that it is read from; tasks get rows (record, chunk) in their order, compress
one after the other and take a running SHA-1, which must end as the stated one. Each task writes
archives of gzip members, one a record, and rolls to a new one at ``ROLL`` bytes. The name of an archive is
fresh for each attempt of a task and the list of archives holds only those of attempts that
ended well, so that lost executors leave no half archive in it.

Reading: archives are streamed; a record is rows (archive, record, chunk) of at most ``CHUNK``
bytes with the running length and SHA-1 of the payload so far. Nothing holds a whole record. The
last chunk of a record is marked, and carries the digest of all of it. ``records`` raises an error for
a record whose bytes are not those that its header states.

Copies: of records with equal payloads of at least ``REVISIT`` bytes, that with the largest page
id is the response and the others are revisits that refer to it. Groups come from a table of
digests, not of payloads, and only digests that occur twice are joined: by broadcast up to
``BROADCAST_DIGESTS``; beyond, still so those that many rows share, and by shuffle the others.

Both sides open archives by URI with pyarrow's file systems, in the shared folder. The block of a
record is an HTTP response, whose Content-Length is that of the full payload for revisits too.

Defined results: a null payload is empty; a null url is written as an empty URI; a null page id is read
back as null and is never referred to. Rows that repeat the largest id of a group are all
responses, with one record id; all other records have ids of their own. Extra columns are ignored.
An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.store import fresh_path, settle

REVISIT = 1000
CHUNK = 1 << 20
ROLL = 1 << 30
#: Digests of copies that are broadcast, at most; more are joined by shuffle.
BROADCAST_DIGESTS = 20_000
#: Digests of at least this share of the rows, so at most as many as its inverse, are always broadcast.
HOT = 1 / 512
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive string, record long, page_id long, record_type string, refers_to long, url string, chunk long, data binary, payload_bytes long, payload_digest string, last boolean, intact boolean"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def planned(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, referred): what is written for each row, and whether others refer to it."""
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("digest"))
    long = rows.where(F.octet_length("payload") >= REVISIT).groupBy("digest")
    copies = long.agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1 and kept is not null").select("digest", "kept", "n")
    copies = settle(copies, "warc-copies")
    found = copies.agg(F.count("*").alias("digests"), F.sum("n").alias("rows")).first()
    if found["digests"] <= BROADCAST_DIGESTS:
        joined = rows.join(F.broadcast(copies.drop("n")), "digest", "left")
    else:
        hot = F.col("n") >= max(HOT * found["rows"], 1000)
        often = F.broadcast(copies.where(hot).drop("n"))  # 1 / HOT rows at most
        rest = rows.join(often, "digest", "left_anti").join(copies.where(~hot).drop("n"), "digest", "left")
        joined = rest.unionByName(rows.join(often, "digest"))
    other = F.when((F.col("kept") != F.col("page_id")) | F.col("page_id").isNull(), F.col("kept"))
    return joined.select("page_id", "url", "payload", "digest", other.alias("refers_to"), F.coalesce(F.col("kept") == F.col("page_id"), F.lit(False)).alias("referred"))


def chunked(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """Records of ``planned`` as rows (page_id, url, n_bytes, digest, refers_to, referred, chunk, last, data), each record's in their order; revisits have one, without data."""
    n = F.octet_length("payload")
    last = F.when(F.col("refers_to").isNull(), F.greatest(F.ceil(n / size) - 1, F.lit(0))).otherwise(F.lit(0)).cast("int")
    rows = records.select("page_id", "url", "payload", "digest", "refers_to", "referred", n.cast("long").alias("n_bytes"), last.alias("end"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), "end")).alias("chunk"))
    data = F.when(F.col("refers_to").isNull(), F.substring("payload", F.col("chunk") * size + 1, F.lit(size))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "n_bytes", "digest", "refers_to", "referred", "chunk", (F.col("chunk") == F.col("end")).alias("last"), data.alias("data"))


def record_urn(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _head(page_id, url, n_bytes, digest, refers_to, name: str) -> bytes:
    """All of a record that comes before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    length = len(http) + (n_bytes if refers_to is None else 0)
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_urn(name)}", "WARC-Date: 2000-01-01T00:00:00Z",
            f"WARC-Target-URI: {''.join(url.splitlines())}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_urn(f'page:{refers_to}')}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http


def write(records: DataFrame, folder: str | None = None, size: int = CHUNK) -> DataFrame:
    """Write the records of ``planned``; (archive, records), a row for each archive."""
    folder = folder or fresh_path(records.sparkSession, "warc")

    def work(batches):
        from pyspark import TaskContext

        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        task, out, name, n, written, done = TaskContext.get().partitionId(), None, "", 0, 0, []
        squeeze = sha = None
        for batch in batches:
            head = [batch.column(i).to_pylist() for i in range(8)]
            data = batch.column(8)
            for i in range(batch.num_rows):
                page_id, url, n_bytes, digest, refers_to, referred, chunk, last = (c[i] for c in head)
                if out is None:
                    name = f"part-{task:05d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, written = system.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                if chunk == 0:
                    squeeze, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    own = f"page:{page_id}" if referred else f"row:{name}:{n}"
                    written += out.write(squeeze.compress(_head(page_id, url, n_bytes, digest, refers_to, own))) or 0
                piece = data[i].as_buffer()
                sha.update(piece)
                written += out.write(squeeze.compress(piece)) or 0
                if not last:
                    continue
                if refers_to is None and sha.hexdigest() != digest:
                    raise ValueError(f"a payload changed while it was written: page {page_id}")
                written += out.write(squeeze.compress(b"\r\n\r\n") + squeeze.flush()) or 0
                n += 1
                if written >= ROLL:
                    out.close()
                    done.append((name, n))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{x}" for x, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], ["archive", "records"])

    return settle(chunked(records, size).mapInArrow(work, "archive string, records long"), "warc-list")


def _headers(stream) -> tuple[str, dict[str, str]] | None:
    """The version line and the fields before the next empty line; None at the end of the archive."""
    first = stream.readline(1 << 16)
    while first in (b"\r\n", b"\n"):
        first = stream.readline(1 << 16)
    if not first:
        return None
    fields = {}
    while (line := stream.readline(1 << 20)) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    return first.decode("utf-8", "replace").strip(), fields


def chunks(stream, data: bool = True, size: int = CHUNK):
    """The records of an open archive, as tuples in the order of CHUNKS without the archive."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    record = 0
    while (found := _headers(stream)) is not None:
        version, head = found
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:60]!r}")
        left = int(head["content-length"])
        kind, url = head["warc-type"], head.get("warc-target-uri", "")
        page, other = (int(head[k]) if k in head else None for k in ("x-page-id", "x-refers-to-page-id"))
        stated = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex() if "warc-payload-digest" in head else None
        block_length = None
        if head.get("content-type", "").startswith("application/http"):
            taken = 0
            while True:
                line = stream.readline(1 << 16)
                taken += len(line)
                if line.lower().startswith(b"content-length:"):
                    block_length = int(line.split(b":")[1])
                if line in (b"\r\n", b"\n", b"") or taken >= left:
                    break
            left -= taken
        if kind == "revisit":
            yield record, page, kind, other, url, 0, b"" if data else None, block_length, stated, True, True
            record += 1
            continue
        sha, total, chunk = hashlib.sha1(), 0, 0
        while True:
            piece = stream.read(min(size, left))
            left -= len(piece)
            total += len(piece)
            sha.update(piece)
            last = left <= 0 or not piece
            digest = sha.copy().hexdigest()
            yield record, page, kind, other, url, chunk, piece if data else None, total, digest, last, (not last) or (left == 0 and stated in (None, digest))
            chunk += 1
            if last:
                break
        record += 1


def read(archives: DataFrame, data: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunked record table of a list of archives; without ``data`` the bytes are read, hashed and let go."""
    n = max(1, archives.count())
    listed = archives.select("archive").repartitionByRange(n, "archive")

    def work(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                system, path = _filesystem(archive)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for row in chunks(stream, data, size):
                        rows.append((archive, *row))
                        held += len(row[6] or b"")
                        if held >= 8 * CHUNK or len(rows) >= 2000:
                            yield _table(rows)
                            rows, held = [], 0
                if rows:
                    yield _table(rows)

    return listed.mapInArrow(work, CHUNKS)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def records(table: DataFrame, strict: bool = True) -> DataFrame:
    """One row a record: the last chunks of a chunked record table. ``strict``: a damaged record is an error."""
    intact = F.col("intact")
    if strict:
        name = F.concat(F.lit("damaged record "), F.col("record").cast("string"), F.lit(" in "), "archive")
        intact = F.when(intact, F.lit(True)).otherwise(F.raise_error(name).cast("boolean"))
    ends = table.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", intact.alias("intact"), "archive", "record")
    return ends.where("intact") if strict else ends
