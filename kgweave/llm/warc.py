"""WARC: deterministic sharded writer, and a reader of what it committed."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgweave.llm.base import new_folder, small, table

#: Compressed bytes after which a file is closed and the next begun.
ROLL_BYTES = 256 << 20
#: Payload bytes of a shard: the lesser up to so many shards, then the greater.
SHARD_BYTES, SMALL_SHARDS, LARGE_SHARD_BYTES = 8 << 20, 64, 1 << 30
#: Regenerated headers are the same on every run.
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, bytes long, records long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = b"\r\n"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as a gzip member of its own; digests and lengths are computed here."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + CRLF + CRLF
    block = http if revisit else http + payload
    uri = (url or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {uri}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: {_id(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as f:
        f.write("\r\n".join(head).encode() + CRLF + CRLF + block + CRLF + CRLF)
    return out.getvalue()


class _Roller:
    """Files of one task: written under a temporary name of this attempt, renamed when whole.

    The final name holds a digest of the bytes, so attempts of one task agree in names and contents: nothing that may
    be committed already is ever replaced or deleted.
    """

    def __init__(self, uri: str, shard: int, attempt: int, limit: int):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)
        self.shard, self.attempt, self.limit, self.seq, self.out = shard, attempt, limit, 0, None
        self.done: list[tuple[str, int, int, str]] = []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.temp = f"{self.root}/_temporary-{self.attempt}-{self.shard:05d}-{self.seq:05d}"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        digest = self.sha.hexdigest()
        name = f"part-{self.shard:05d}-{self.seq:05d}-{digest[:16]}.warc.gz"
        found = self.fs.get_file_info(f"{self.root}/{name}")
        if found.type == pafs.FileType.File and found.size == self.size:  # another attempt's
            self.fs.delete_file(self.temp)
        else:
            self.fs.move(self.temp, f"{self.root}/{name}")
        self.done.append((name, self.size, self.records, digest))
        self.out, self.seq = None, self.seq + 1


def shards_for(payload_bytes: int) -> int:
    """A number that depends on the data alone, so that the same pages give the same files on any cluster."""
    return max(1, min(SMALL_SHARDS, -(-payload_bytes // SHARD_BYTES)), -(-payload_bytes // LARGE_SHARD_BYTES))


def write_warc(pages: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write page_id, url, html as WARC files below ``uri`` and return the manifest (MANIFEST), itself a table there.

    Records are range-sorted by url, page_id and payload, so that neighbours compress well and each shard's files are
    the same on every run. Of records with equal payloads that with the greatest (page_id, url) is the response, the
    others are revisits of it; of rows alike in all three the first is. A null html is an empty payload; a null page_id
    or url is written as empty. An empty table gives an empty manifest; other columns play no part. Only files that the
    manifest names are committed: what lost attempts leave is not read. The number of shards follows from the payloads'
    bytes (shards_for).
    """
    spark = pages.sparkSession
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    shared = hashed.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    shared = spark.read.schema(shared.schema).parquet(_saved(shared, f"{uri}/_shared"))
    joined = hashed.join(small(shared, shared.count(), 50_000), "digest", "left")
    order = ["url", "page_id", "digest"]
    n = shards or shards_for(pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0])
    ranged = joined.repartitionByRange(n, *order).sortWithinPartitions(*order).select("page_id", "url", "html", "digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("first").isNotNull().alias("shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        roller = _Roller(uri, context.partitionId(), context.taskAttemptId(), roll_bytes)
        last = None
        for batch in batches:
            for page_id, url, html, digest, first_id, first_url, is_shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                me = (page_id, url, digest)
                revisit = is_shared and ((page_id, url) != (first_id, first_url) or me == last)
                last = me
                roller.write(record_bytes(page_id, url, html.encode(), first_id, revisit))
        roller.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*roller.done, strict=True)) or [[]] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["file", "bytes", "records", "sha256"])

    return spark.read.schema(MANIFEST).parquet(_saved(ranged.mapInArrow(run, MANIFEST), f"{uri}/_manifest"))


def _saved(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, one record in memory at a time."""
    while line := stream.readline():
        if line in (CRLF, b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (CRLF, b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        yield headers, stream.read(int(headers["Content-Length"]))


def read_warc(manifest: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """RECORD rows (and ``html``) of every file of the manifest. Payload digests of responses are computed anew and must agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(uri)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), *([pa.string()] if payloads else [])]
        names = [f.split()[0] for f in RECORD.split(", ")] + ["html"] * payloads

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            for name in b.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    for h, block in parse(stream):
                        kind = h["WARC-Type"]
                        payload = block.partition(CRLF + CRLF)[2]
                        digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and digest32(payload) != digest:
                            raise ValueError(f"{name}: payload digest of {h['WARC-Record-ID']} differs")
                        number = lambda k: int(x) if (x := h.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None  # noqa: E731, B023
                        url = h.get("WARC-Target-URI")
                        url = url if url is None else url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        rows.append((number("WARC-Record-ID"), url, len(payload) if kind == "response" else int(h["X-Payload-Length"]), digest, kind, number("WARC-Refers-To"), name, *([payload.decode()] if payloads else [])))
                        size += len(payload) * payloads + 200
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    # one file a task: a plain number of partitions is kept as it is
    return manifest.select("file").repartition(max(1, manifest.count())).mapInArrow(run, RECORD + ", html string" * payloads)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written for each page, as read back from the archives. Nulls and repeated rows as in write_warc."""
    uri = new_folder(spark, "warc")
    manifest = write_warc(table(spark, sf_dir, "pages"), uri)
    return read_warc(manifest, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file")

