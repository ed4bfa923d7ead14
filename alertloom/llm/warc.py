"""WARC archives of web pages, compressed record by record with a Zstandard dictionary.

Each task writes archives of its own: the first records of an archive train a dictionary, which stands in a
leading skippable frame, and every record is a frame of its own that needs only that dictionary. Files are
written under names that no other attempt uses, through the file system of the target folder, and count only
once they are in the manifest; a lost or repeated task leaves an orphan that nobody reads.

Defined results: the payload is the html in UTF-8, empty for null. Of rows with equal payloads those with the
smallest page id are responses, the others revisit that id; if no page with a payload has an id, all its rows
are responses. Repeated rows are archived one by one. Control characters in a URL are percent-encoded, a null
URL is left out. A very long page is one record and is held whole by the one task that writes it. No pages give
no archives and an empty manifest.
"""

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from alertloom.session import cut_lineage, delete_on_exit, shared_dir

DICTIONARY_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 32 << 10, 1 << 20, 400
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
MIN_PAYLOAD = 0
DATE = "1970-01-01T00:00:00Z"
# fixed by the format: the magic number of the skippable frame that holds a dictionary, and of a dictionary
FRAME_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, first_id, is_revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}", "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first_id}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]):
    """Dictionary from records, at most ``SAMPLE_BYTES`` of them; raw content where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """One file: the dictionary frame, then a frame per record."""

    def __init__(self, folder: str):
        self.store, base = fs.FileSystem.from_uri(folder)
        self.path = f"{base}/{uuid.uuid4().hex}.warc.zst"
        self.waiting, self.waiting_bytes, self.out, self.written, self.count = [], 0, None, 0, 0

    def add(self, data: bytes):
        self.count += 1
        if self.out is None:
            self.waiting.append(data)
            self.waiting_bytes += len(data)
            if self.waiting_bytes < SAMPLE_BYTES and len(self.waiting) < SAMPLE_RECORDS:
                return
            self._start()
        else:
            self._put(data)

    def _start(self):
        kept, size = [], 0
        for x in self.waiting:  # a huge record lends only its beginning to the dictionary
            kept.append(x[: SAMPLE_BYTES - size])
            size += len(kept[-1])
            if size >= SAMPLE_BYTES:
                break
        words = train(kept)
        body = words.as_bytes()
        self.out = self.store.open_output_stream(self.path)
        self.out.write(struct.pack("<II", FRAME_MAGIC, len(body)) + body)
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words)
        for x in self.waiting:
            self._put(x)
        self.waiting = []

    def _put(self, data):
        frame = self.press.compress(data)
        self.out.write(frame)
        self.written += len(frame)

    def close(self):
        if self.out is None:
            self._start()
        self.out.close()
        return self.path, self.count


def _writer(folder):
    def write(stream):
        archive, done = None, []
        for batch in stream:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for page_id, url, html, first_id, again in zip(*cols):
                if archive is None:
                    archive = Archive(folder)
                payload = (html.as_py() or "").encode()
                archive.add(record(page_id.as_py(), url.as_py(), payload, first_id.as_py(), again.as_py()))
                if archive.written >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"])

    return write


def records_of(store, path):
    """Records of an archive as (headers, block), read frame by frame."""
    with store.open_input_stream(path) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != FRAME_MAGIC:
            raise ValueError(f"{path} has no leading dictionary frame")
        body = source.read(size)
        trained = body[:4] == struct.pack("<I", DICTIONARY_MAGIC)
        words = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
        press = zstandard.ZstdDecompressor(dict_data=words)
        rest = b""
        while True:
            rest = rest or source.read(1 << 20)
            if not rest:
                return
            frame, parts = press.decompressobj(), []
            while True:
                parts.append(frame.decompress(rest))
                rest = frame.unused_data
                if frame.eof:
                    break
                rest = source.read(1 << 20)
                if not rest:
                    raise ValueError(f"{path} ends inside a record")
            yield parse(b"".join(parts))


def parse(data: bytes):
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of the wrong length")
    return headers, rest[:size]


def _reader(folder):
    def read(stream):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in stream:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in records_of(store, path):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    page, kind, target = headers.get("X-Page-Id"), headers["WARC-Type"], headers.get("WARC-Refers-To")
                    if kind == "response" and digest(payload) != said:
                        raise ValueError(f"{path}: payload of page {page} is damaged")
                    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    rows.append((None if page is None else int(page), length, said, kind, None if target is None else int(target[len("<urn:page:") : -1]), headers.get("WARC-Target-URI")))
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    return read


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())])


def _batch(rows):
    return pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r)) for r in rows], _ROW)


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, first_id, is_revisit``: payloads are compared by SHA-1 and length, minima are pre-aggregated."""
    body = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html",
                        F.sha1(body).alias("_sha"), F.octet_length(body).cast("long").alias("_n"))
    first = rows.where(F.col("_n") >= MIN_PAYLOAD).groupBy("_sha", "_n").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_rows"))
    again = rows.select("page_id", "_sha", "_n").join(first.where("_rows > 1 and first_id is not null").drop("_rows"), ["_sha", "_n"]) \
        .where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select(F.col("page_id").alias("_p"), F.col("_sha").alias("_s"), "first_id").distinct()
    joined = rows.join(again, rows["page_id"].eqNullSafe(again["_p"]) & (rows["_sha"] == again["_s"]), "left")
    return joined.select("page_id", "url", "html", "first_id", F.col("first_id").isNotNull().alias("is_revisit"))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes the pages and returns the manifest ``path, records`` of the archives."""
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
        delete_on_exit(spark, folder)
    manifest = cut_lineage(plan_records(pages).mapInArrow(_writer(_uri(spark, folder)), "path string, records long"))
    manifest._folder = folder
    return manifest


def _uri(spark, folder: str) -> str:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    made = store.makeQualified(path).toUri().toString()
    return "file://" + made[5:] if made.startswith("file:/") and not made.startswith("file://") else made


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` of every record in the manifest."""
    spark = manifest.sparkSession
    spread = manifest.select("path").repartition(max(1, spark.sparkContext.defaultParallelism))
    return spread.mapInArrow(_reader(_uri(spark, folder)), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
