"""WARC archives: writing with revisit records, and a reader that salvages what follows damage."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.session import scratch_path

from .common import arrow_rows, cut_lineage

# Fixed values of the format and of the contract.
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
SHARED_BYTES = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

FILE_BYTES = 64 << 20  # an archive is closed beyond this size
READ_BYTES = 1 << 16  # read at once; a record that needs more doubles it
HELD_BYTES = 1 << 20  # payloads handed on together
DATE = "2026-01-01T00:00:00Z"


def storage(path: str):
    """(file system, path inside it) of a Spark path: any shared store, not only mounted folders."""
    from pyarrow import fs

    if path.startswith("s3a://"):
        path = "s3://" + path[6:]
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed.  A revisit holds the HTTP head only; its digest and length are the full payload's."""
    block = HTTP if revisit else HTTP + payload
    clean = (url or "").encode().replace(b"\r", b"%0D").replace(b"\n", b"%0A").decode()
    uid = hashlib.sha1(f"{page_id} {clean} {digest}".encode()).hexdigest()
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:sha1:{uid}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}",
            f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}", f"Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of one uncompressed record; ValueError if any check fails."""
    end = raw.find(b"\r\n\r\n")
    if not raw.startswith(b"WARC/1.") or end < 0:
        raise ValueError("no version line or header end")
    header = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("malformed header line")
        header[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = int(header.get("content-length", "-1"))
    block = raw[end + 4:end + 4 + length]
    if length < 0 or len(block) != length or raw[end + 4 + length:end + 8 + length] != b"\r\n\r\n":
        raise ValueError("block is cut short or runs on")
    kind, _, want = header.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and hashlib.sha1(block).hexdigest() != want:
        raise ValueError("block digest differs")
    header["content-size"] = str(end + 8 + length)
    return header, block


class Window:
    """A stretch of a stream: grows at its end on demand, is dropped at its start once read, which copies nothing."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.data, self.base, self.ended = read, bytearray(), 0, False

    def more(self) -> bool:
        got = b"" if self.ended else self.read(max(READ_BYTES, len(self.data)))
        self.ended = not got
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        del self.data[:n]
        self.base += n

    def find(self, marks: tuple[bytes, ...], start: int) -> int:
        """Place of the first mark at or after ``start``; at the stream's end its length."""
        longest = max(map(len, marks))
        while True:
            found = [i for i in (self.data.find(m, start) for m in marks) if i >= 0]
            if found and (self.ended or min(found) + longest <= len(self.data)):
                return min(found)
            start = max(start, len(self.data) - longest)
            if not self.more():
                return min(found, default=len(self.data))


def _member(w: Window) -> tuple[bytes, int]:
    """The gzip member at the window's start, unpacked, and its packed size."""
    unpack, fed, out = zlib.decompressobj(31), 0, []
    while not unpack.eof:
        if fed == len(w.data) and not w.more():
            raise ValueError("member is cut short")
        try:
            out.append(unpack.decompress(w.data[fed:]))
        except zlib.error as e:
            raise ValueError(f"member is damaged: {e}") from e
        fed = len(w.data)
    return b"".join(out), fed - len(unpack.unused_data)


def _plain(w: Window) -> tuple[bytes, int]:
    """The uncompressed record at the window's start, and its size."""
    end = w.find((b"\r\n\r\n",), 0)
    size = None
    for line in w.data[:end].split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length" and value.strip().isdigit():
            size = end + 8 + int(value)
    if size is None:
        raise ValueError("no length")
    while len(w.data) < size and w.more():
        pass
    return bytes(w.data[:size]), size


def salvage(read: Callable[[int], bytes]) -> Iterator[tuple]:
    """Records and gaps of one archive, in order: ("record", start, end, header, block) or ("gap", start, end, reason).

    ``read(n)`` gives the next bytes.  Members may be packed or plain.  Where a member fails a check, the search goes on
    one byte behind its start, for the next gzip magic or version line that begins a sound record; the bytes
    up to there are a gap.
    """
    w = Window(read)
    gap: tuple[int, str] | None = None
    while w.data or w.more():
        while len(w.data) < len(VERSION) and w.more():
            pass
        try:
            if w.data.startswith(MAGIC):
                raw, size = _member(w)
            elif w.data.startswith(b"WARC/1."):
                raw, size = _plain(w)
            else:
                raise ValueError("neither a member nor a version line")
            header, block = parsed(raw)
        except ValueError as e:
            gap = gap or (w.base, str(e))
            w.drop(w.find((MAGIC, b"WARC/1."), 1))
            continue
        if gap:
            yield "gap", gap[0], w.base, gap[1]
            gap = None
        yield "record", w.base, w.base + size, header, block
        w.drop(size)
    if gap:
        yield "gap", gap[0], w.base, gap[1]


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages as records: (page_id, url, html, digest, revisit, refers_to).

    Only digests and ids are grouped.  Of equal payloads of at least ``SHARED_BYTES`` bytes the row with the largest page id
    is stored; a group's size never meets in one task.
    """
    base = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(html, F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8")))
    shared = cut_lineage(base.where(F.octet_length("html") >= SHARED_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "kept"))
    revisit = F.coalesce(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.lit(False))
    return base.join(shared, F.col("digest") == F.col("d"), "left").select(
        "page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html",
                   file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row below ``folder``, a gzip member each; returns (path, records, bytes) of the archives.

    The returned table is written before it is handed on, so it names the archives of finished attempts only; what a lost
    attempt left behind has another name and is never read.  Null texts are empty payloads; rows with a null key
    never are the stored copy of another; rows repeated with the largest key are all stored.
    """
    arrow_rows(pages.sparkSession, 128)

    def written(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        out, done = None, []

        def close() -> None:
            nonlocal out
            if out:
                out["stream"].close()
                done.append((out["path"], out["records"], out["bytes"]))
                out = None

        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                page_id, link, text, digest, revisit, refers = (c[i].as_py() for c in columns)
                raw = record(page_id, link, text.encode("utf-8", "surrogatepass"), digest, refers, revisit)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = pack.compress(raw) + pack.flush()
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, place = storage(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    out = {"path": path, "stream": store.open_output_stream(place, compression=None), "records": 0, "bytes": 0}
                out["stream"].write(member)
                out["records"] += 1
                out["bytes"] += len(member)
                if out["bytes"] >= file_bytes:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*done), (pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return cut_lineage(plan_records(pages, key, url, html).mapInArrow(written, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives named in ``archives.path``, one row each.

    ``kind`` is record or gap; ``start`` and ``end`` are byte places in the archive.  Records have their header fields and
    payload; for a revisit the payload is null and digest and length are those of the payload it stands for.  Without
    ``payloads`` the payloads are checked and measured, but not handed on.
    """
    # an explicit number, one archive a partition: paths are so small that they would be put together
    paths = archives.select("path")
    files = paths.repartitionByRange(max(paths.count(), 1), "path")

    def opened(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(),
                 pa.string(), pa.int64(), pa.binary())
        names = ["path", "kind", "start", "end", "reason", "page_id", "url", "payload_bytes", "payload_digest", "record_type",
                 "refers_to", "payload"]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        number = lambda h, k: int(h[k]) if k in h else None
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, place = storage(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for kind, start, end, *rest in salvage(stream.read):
                        if kind == "gap":
                            rows.append((path, kind, start, end, rest[0], *[None] * 7))
                        else:
                            h, block = rest
                            stored = h.get("warc-type") == "response"
                            payload = block[block.find(b"\r\n\r\n") + 4:] if stored else None
                            digest = hashlib.sha1(payload).hexdigest() if stored else h.get("warc-payload-digest", "").rpartition(":")[2]
                            rows.append((path, kind, start, end, None, number(h, "page-id"), h.get("warc-target-uri"),
                                         len(payload) if stored else number(h, "payload-length"), digest, h.get("warc-type"),
                                         number(h, "refers-to-page-id"), payload if payloads else None))
                            held += len(payload or b"") * payloads
                        if held > HELD_BYTES or len(rows) >= 4096:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return files.mapInArrow(opened, "path string, kind string, start long, end long, reason string, page_id long, url string, "
                            "payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(spark: SparkSession, pages: DataFrame, payloads: bool = True) -> DataFrame:
    """Writes all pages to archives in the shared scratch folder and reads them back."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc")), payloads)
