"""WARC archives as a chunked record table.

Writing: payloads are cut into segments of CHUNK characters at most; each is a WARC record of its
own (the first a response, the rest continuations with origin and number), a row that Spark's
text writer puts out with the record's closing line breaks as separator. Payloads that occur again
(of MIN_REVISIT bytes or more) are kept once and revisited. Reading: lines of a file come in order
to one task (gzip files aren't split), which follows the headers' lengths and emits a row per
record identifier and chunk number, with the digest and the size of the payload so far. Neither
side holds more than a chunk or a line of a record.

Nulls, ties and edges: null html is an empty payload; a null url is left out; line breaks in a url
are escaped; a null page id is written as "null" and is the smallest; of rows that share the
largest id of equal payloads each is a response; an empty table gives an empty archive; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha1

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrid.llm.common import new_path, table

MIN_REVISIT = 1000
CHUNK = 1 << 16
_URN = "urn:page:"
_END = "\r\n\r\n"


def _lines(*parts: tuple[str, Column] | Column) -> Column:
    """Header lines, the null ones left out, with the blank line that ends them."""
    cols = [F.concat(F.lit(p[0] + ": "), p[1]) if isinstance(p, tuple) else p for p in parts]
    return F.concat(F.concat_ws("\r\n", *cols), F.lit(_END))


def _with_original(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, size, refers_to): the page that keeps the payload, if another."""
    html = F.coalesce("html", F.lit(""))
    df = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    # Rows of one payload meet as a count and a largest id, never as a group.
    large = df.where(F.col("size") >= MIN_REVISIT).select("digest", "size", "page_id")
    kept = large.groupBy("digest", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("times")).where("times > 1").drop("times")
    df = df.join(kept, ["digest", "size"], "left")
    other = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return df.withColumn("refers_to", F.when(other, F.col("kept"))).drop("kept")


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK) -> None:
    """Writes a gzip WARC file per task, by Spark's writer, to any store that Spark reaches."""
    df = _with_original(pages)
    name = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    http = _lines(F.lit("HTTP/1.1 200 OK"), ("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size").cast("string")))
    size = F.length("html")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(chunk)).cast("int") - 1, F.lit(0)))
    cut = F.when(F.col("refers_to").isNull(), F.transform(starts, lambda i: F.struct(i.alias("i"), F.substring("html", i * chunk + 1, F.lit(chunk)).alias("b"))))
    cut = F.coalesce(cut, F.array(F.struct(F.lit(0).alias("i"), F.lit("").alias("b"))))
    df = df.select("page_id", "url", "digest", "size", "refers_to", F.ceil(size / F.lit(chunk)).alias("parts"), http.alias("http"), F.explode_outer(cut).alias("s"))
    first, last = F.col("s.i") == 0, F.col("s.i") >= F.col("parts") - 1
    many = (F.col("parts") > 1) & F.col("refers_to").isNull()
    block = F.when(first, F.concat("http", "s.b")).otherwise(F.col("s.b"))
    id_ = F.when(first, name("page_id")).otherwise(F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), F.col("s.i").cast("string"), F.lit(">")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = _lines(
        F.lit("WARC/1.1"),
        ("WARC-Type", F.when(~first, F.lit("continuation")).when(F.col("refers_to").isNotNull(), F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", id_),
        ("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        ("WARC-Target-URI", F.when(first, url)),
        ("WARC-Payload-Digest", F.when(first, F.concat(F.lit("sha1:"), "digest"))),
        ("WARC-Profile", F.when(F.col("refers_to").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("WARC-Refers-To", F.when(F.col("refers_to").isNotNull(), name("refers_to"))),
        ("WARC-Segment-Number", F.when(many, (F.col("s.i") + 1).cast("string"))),
        ("WARC-Segment-Origin-ID", F.when(~first, name("page_id"))),
        ("WARC-Segment-Total-Length", F.when(many & last, F.col("size").cast("string"))),
        ("Content-Type", F.when(first, F.lit("application/http; msgtype=response"))),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    out = df.select(F.concat(header, block).alias("value"))
    out.write.option("lineSep", _END).option("compression", "gzip").text(path)


_FIELDS = "record_id string, record_type string, refers_to string, url string, chunk_no bigint, is_last boolean, payload_bytes bigint, payload_digest string, data binary"
_KINDS = [pa.string()] * 4 + [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]


class _Record:
    """Where the reader stands in a record (all its segments)."""

    def __init__(self, head: dict[str, str]):
        self.head, self.hash, self.size, self.chunk = head, sha1(), 0, 0
        self.http: dict[str, str] | None = {} if "http" in head.get("content-type", "") else None

    def row(self, data: bytes, last: bool, with_data: bool):
        h = self.head
        size, digest = self.size, self.hash.hexdigest()
        if h.get("warc-type") == "revisit":  # the payload is elsewhere; its size and digest are in the headers
            size = int((self.done or {}).get("content-length", 0))
            digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
        self.chunk += 1
        clean = lambda x: x and x.strip("<>")
        return (clean(h.get("warc-record-id")), h.get("warc-type"), clean(h.get("warc-refers-to")), h.get("warc-target-uri"), self.chunk - 1, last, size, digest, data if with_data else None)

    done: dict[str, str] | None = None

    def feed(self, data: bytes) -> bytes:
        """Takes a piece of the block; returns what of it is payload."""
        if self.http is not None:
            if data.strip():
                k, _, v = data.decode("utf-8", "replace").partition(":")
                self.http[k.strip().lower()] = v.strip()
            else:
                self.done, self.http = self.http, None
            return b""
        self.hash.update(data)
        self.size += len(data)
        return data


def _parse(chunk: int, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, head, left, record, held, out = None, None, 0, None, [], []

        def flush():
            cols = list(zip(*out, strict=True)) or [()] * len(_NAMES)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

        def close():
            nonlocal record, held
            if record:
                out.append(record.row(b"".join(held), True, with_data))
            record, held = None, []

        for batch in batches:
            for name, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if name != file:
                    close()
                    file, head, left = name, None, 0
                if left > 0:  # inside a block: the line and its break, as far as the length says
                    piece = (line + b"\n")[:left]
                    left -= len(piece)
                    got = record.feed(piece)
                    if got:
                        held.append(got)
                        if sum(map(len, held)) >= chunk:
                            out.append(record.row(b"".join(held), False, with_data))
                            held = []
                elif head is None:
                    if line.startswith(b"WARC/"):
                        head = {}
                elif line.strip():
                    k, _, v = line.decode("utf-8", "replace").partition(":")
                    head[k.strip().lower()] = v.strip()
                else:
                    if head.get("warc-type") != "continuation":
                        close()
                        record = _Record(head)
                    left, head = int(head.get("content-length", 0)), None
            yield flush()
        close()
        yield flush()

    return run


def read_warc(spark: SparkSession, path: str, chunk: int = CHUNK, with_data: bool = True) -> DataFrame:
    """The chunk table: a row per record and chunk; the digest and size are of the payload so far."""
    lines = spark.read.option("lineSep", "\n").text(path + "/*.gz")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    return lines.mapInArrow(_parse(chunk, with_data), _FIELDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    rows = read_warc(spark, path, with_data=False).where("is_last")
    page = lambda c: F.expr(f"try_cast(substring({c}, {len(_URN) + 1}) as bigint)")
    return rows.select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


SQL = f"""
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select html, max(page_id) as kept from p group by html)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= {MIN_REVISIT} and page_id is distinct from kept then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {MIN_REVISIT} and page_id is distinct from kept then kept end as refers_to
from p join k using (html)
"""
