"""WARC archives as a Spark data source, and page captures with revisit records.

``spark.read.format("warc").load(folder)`` plans file partitions, evaluates the predicates that
Spark pushes down on the record headers (type, id, address, digest, lengths), and reads a
record's block only if its headers pass and the payload column is asked for.  Files are plain
or gzip, one member a record or all in one.  Archives written here are gzip with one member a
record; a member names its own compressed length in its extra field, so an unwanted record is
skipped by a seek, without inflating it.

``df.write.format("warc")`` writes ``part-*.warc.gz`` files.  Files of a job count only when its
commit has put their names, and the places where they may be cut into partitions, into a
manifest beside them: attempts of lost executors are never read.  A folder without a manifest
is read whole.  File systems are those of pyarrow (local or shared folders, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from proxima.llm.common import join_groups, write_table
from proxima.session import scratch_path, ship_package

#: column -> header field
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date",
           "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type",
           "content_length": "content-length", "payload_length": "warc-payload-length"}
NUMBERS = {"content_length", "payload_length"}
SCHEMA = ", ".join(f"{c} {'bigint' if c in NUMBERS else 'string'}" for c in HEADERS) + ", headers map<string, string>, payload binary"
FIELD_NAMES = {"warc-type": "WARC-Type", "warc-record-id": "WARC-Record-ID", "warc-target-uri": "WARC-Target-URI", "warc-date": "WARC-Date",
               "warc-payload-digest": "WARC-Payload-Digest", "warc-refers-to": "WARC-Refers-To", "warc-payload-length": "WARC-Payload-Length",
               "content-type": "Content-Type"}
# fixed values of the format
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
HTTP = "application/http; msgtype=response"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PARTITION_BYTES = 64 << 20  # of files, a partition
FILE_BYTES = 1 << 30        # of a written file
CUT_BYTES = 4 << 20         # between the places where a written file may be cut
BATCH_BYTES, BATCH_ROWS = 8 << 20, 1000
HEADER_BYTES = 1 << 20      # longer headers are an error
CHUNK = 1 << 16
LEAST_REVISIT = 100         # bytes of a payload from which equal ones become revisits
DATE = "1970-01-01T00:00:00Z"


def file_system(path: str):
    """(file system, path in it) of a folder named as Spark names it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


# ---------------------------------------------------------------- reading

class Records:
    """The bytes of a file's records from ``start``; a record that starts at ``end`` or later
    is not this reader's."""

    def __init__(self, f, size: int, start: int = 0, end: int | None = None):
        self.f, self.end = f, size if end is None else end
        f.seek(start)
        self.raw, self.raw_at, self.left = b"", start, size - start  # raw[0] stands at raw_at of the file
        self._more()
        self.gz = self.raw[:2] == b"\x1f\x8b"
        self.inflate, self.buf, self.member = None, bytearray(), None

    def _more(self) -> bool:
        got = self.f.read(min(CHUNK, self.left)) if self.left else b""
        self.raw, self.left = self.raw + got, self.left - len(got)
        return bool(got)

    def _fill(self) -> bool:
        """More plain bytes in ``buf``; False at the end of the file."""
        if not self.gz:
            self.buf += self.raw
            self.raw_at, self.raw = self.raw_at + len(self.raw), b""
            return bool(self._more()) or bool(self.buf)
        while True:
            if self.inflate is None:
                while len(self.raw) < 24 and self._more():
                    pass
                if not self.raw:
                    return False
                self.member = (self.raw_at, self._member_length())
                self.inflate = zlib.decompressobj(31)
            if not self.raw and not self._more():
                raise ValueError("a gzip member ends early")
            before = len(self.raw)
            out = self.inflate.decompress(self.raw, CHUNK)
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.raw_at, self.raw = self.raw_at + before - len(rest), rest
            if self.inflate.eof:
                self.inflate = None
            if out:
                self.buf += out
                return True

    def _member_length(self) -> int | None:
        r = self.raw[:24]
        if len(r) == 24 and r[3] & 4 and r[10:16] == b"\x0c\x00sl\x08\x00":
            return struct.unpack("<I", r[16:20])[0] or None
        return None

    def place(self) -> int:
        """Where the next record starts in the file (in a gzip file: its member)."""
        return self.raw_at if not self.buf or self.inflate is None and self.gz else self.raw_at - (0 if self.gz else len(self.buf))

    def header(self) -> bytes | None:
        """The next record's header, None after the last one of this range."""
        while True:
            if not self.buf and self.inflate is None:
                if self.raw_at >= self.end:
                    return None
                self.member = None
            elif not self.gz and self.raw_at - len(self.buf) >= self.end:
                return None
            at = self.buf.find(END)
            if at >= 0:
                head = bytes(self.buf[:at])
                del self.buf[:at + 4]
                return head
            if len(self.buf) > HEADER_BYTES:
                raise ValueError("a record's header does not end")
            n = len(self.buf)
            if not self._fill() or (not self.gz and len(self.buf) == n):
                if self.buf.strip(b"\r\n"):
                    raise ValueError("a record's header ends early")
                return None

    def read(self, n: int) -> bytes:
        while len(self.buf) < n:
            had = len(self.buf)
            if not self._fill() or len(self.buf) == had:
                raise ValueError("a record's block ends early")
        out = bytes(self.buf[:n])
        del self.buf[:n]
        return out

    def skip(self, n: int) -> None:
        """Past the ``n`` bytes left of a record: by a seek if the file allows it."""
        if n <= len(self.buf):
            del self.buf[:n]
        elif not self.gz:
            self._seek(self.raw_at + n - len(self.buf))
        elif self.member and self.member[1]:
            self._seek(self.member[0] + self.member[1])
            self.inflate = None
        else:
            while n > len(self.buf):
                n -= len(self.buf)
                self.buf.clear()
                if not self._fill():
                    raise ValueError("a record's block ends early")
            del self.buf[:n]
        if self.gz and not self.buf and self.inflate is not None and self.member and self.member[1]:
            self._seek(self.member[0] + self.member[1])  # nothing but the member's checksum is left
            self.inflate = None

    def _seek(self, to: int) -> None:
        self.buf.clear()
        step = to - self.raw_at
        if step <= len(self.raw):
            self.raw = self.raw[step:]
        else:
            if step - len(self.raw) > self.left:
                raise ValueError("a record's block ends early")
            self.left -= step - len(self.raw)
            self.raw = b""
            self.f.seek(to)
        self.raw_at = to
        if not self.raw:
            self._more()


def parse_header(head: bytes) -> dict[str, str]:
    """Field names in lower case and values; folded lines are joined."""
    lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    out, last = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def column_of(fields: dict[str, str], name: str):
    v = fields.get(HEADERS[name])
    return int(v) if v is not None and name in NUMBERS else v


TESTS = {ds.EqualTo: lambda a, b: a is not None and a == b, ds.EqualNullSafe: lambda a, b: a == b, ds.In: lambda a, b: a is not None and a in b,
         ds.GreaterThan: lambda a, b: a is not None and a > b, ds.GreaterThanOrEqual: lambda a, b: a is not None and a >= b,
         ds.LessThan: lambda a, b: a is not None and a < b, ds.LessThanOrEqual: lambda a, b: a is not None and a <= b,
         ds.StringStartsWith: lambda a, b: a is not None and a.startswith(b), ds.StringEndsWith: lambda a, b: a is not None and a.endswith(b),
         ds.StringContains: lambda a, b: a is not None and b in a, ds.IsNull: lambda a, _: a is None, ds.IsNotNull: lambda a, _: a is not None}


@dataclass
class Piece(ds.InputPartition):
    files: list = field(default_factory=list)  # (path, size, start, end)


class Reader(ds.DataSourceReader):
    def __init__(self, schema, options):
        self.path, self.schema, self.tests = options["path"], schema, []
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def _files(self):
        """(name, size, places where it may be cut)."""
        system, root = file_system(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(root, recursive=True)) if x.type == fs.FileType.File]
        listed = [x for x in found if re.search(r"/_manifest-[^/]*\.json$", x.path)]
        if listed:
            for m in sorted(listed, key=lambda x: x.path):
                with system.open_input_stream(m.path) as f:
                    yield from ((f"{root}/{name}", size, cuts) for name, size, cuts in json.loads(f.read()))
        else:
            yield from sorted((x.path, x.size, []) for x in found if not x.base_name.startswith(("_", ".")))

    def partitions(self):
        out, size = [], self.size
        for path, whole, cuts in self._files():
            edges = [0, *cuts, whole]
            for a, b in zip(edges, edges[1:]):
                if size + (b - a) > self.size:
                    out.append(Piece())
                    size = 0
                last = out[-1].files
                if last and last[-1][0] == path and last[-1][3] == a:
                    last[-1] = (path, whole, last[-1][2], b)
                else:
                    last.append((path, whole, a, b))
                size += b - a
        return out or [Piece()]

    def accepts(self, fields: dict[str, str]) -> bool:
        return all(TESTS[kind](column_of(fields, name), value) for name, kind, value in self.tests)

    def read(self, partition):
        system, _ = file_system(self.path)
        names = self.schema.fieldNames()
        kinds = {"headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), **{c: pa.int64() for c in NUMBERS}}
        rows, held = {c: [] for c in names}, 0
        batch = lambda: pa.record_batch([pa.array(rows[c], kinds.get(c, pa.string())) for c in names], names=names)
        for path, size, start, end in partition.files:
            with system.open_input_file(path) as f:
                try:
                    for fields, payload in records(Records(f, size, start, end), self.accepts, "payload" in rows):
                        for c in names:
                            rows[c].append(payload if c == "payload" else list(fields.items()) if c == "headers" else column_of(fields, c))
                        held += len(payload or b"") + 200
                        if held > BATCH_BYTES or len(rows[names[0]]) >= BATCH_ROWS:
                            yield batch()
                            rows, held = {c: [] for c in names}, 0
                except ValueError as e:
                    raise ValueError(f"{path}: {e}") from e
        if rows[names[0]]:
            yield batch()


def records(src: Records, accepts, wanted: bool):
    """(header fields, payload or None) of the records that ``accepts`` takes by their header."""
    while (head := src.header()) is not None:
        fields = parse_header(head)
        n = int(fields.get("content-length") or 0)
        if not accepts(fields):
            src.skip(n + 4)
            continue
        payload = None
        if wanted:
            payload = src.read(n)
            if fields.get("content-type", "").startswith("application/http"):
                payload = payload.partition(END)[2]
            src.skip(4)
        else:
            src.skip(n + 4)
        yield fields, payload


# ---------------------------------------------------------------- writing

def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member that names its length in its extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    n = 24 + len(body) + 8
    sizes = struct.pack("<II", n if n < 1 << 32 else 0, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\x00sl\x08\x00" + sizes + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(row: dict) -> bytes:
    """One record; line breaks and other control characters in a value are percent-encoded."""
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(v))
    block = b""
    if row.get("payload") is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: %d\r\n\r\n" % len(row["payload"]) + row["payload"]
    lines = [f"{FIELD_NAMES[HEADERS[c]]}: {clean(row[c])}" for c in ("warc_type", "record_id", "target_uri", "warc_date", "payload_digest", "refers_to", "payload_length")
             if row.get(c) is not None]
    if row.get("warc_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    if row.get("payload") is not None:
        lines.append(f"Content-Type: {HTTP}")
    head = "\r\n".join(lines).encode("utf-8", "surrogatepass")
    return VERSION + b"\r\n" + head + b"\r\nContent-Length: %d" % len(block) + END + block + END


@dataclass
class Written(ds.WriterCommitMessage):
    files: list = field(default_factory=list)  # (name, size, cuts)


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))

    def write(self, iterator):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        done, out, name, size, cuts = [], None, "", 0, []
        for b in iterator:
            for i in range(b.num_rows):
                if out is None:
                    name, size, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record_bytes({c: b.column(j)[i].as_py() for j, c in enumerate(b.schema.names)}))
                if size - (cuts[-1] if cuts else 0) >= CUT_BYTES:
                    cuts.append(size)
                out.write(data)
                size += len(data)
                if size >= self.file_bytes:
                    out.close()
                    done.append((name, size, cuts))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, cuts))
        return Written(done)

    def commit(self, messages):
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        old = [x.path for x in system.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("_manifest-")] if self.overwrite else []
        files = sorted(f for m in messages if m for f in m.files)
        with system.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(files).encode())
        for m in old:
            system.delete_file(m)  # what it listed is no longer read

    def abort(self, messages):
        system, root = file_system(self.path)
        for m in messages:
            for name, *_ in m.files if m else ():
                system.delete_file(f"{root}/{name}")


class WarcSource(ds.DataSource):
    """Options: path; partition_bytes (read); file_bytes (write).  A schema with some of the
    columns reads only those; without payload no block is read."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(schema, self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``warc`` known to the session and let Spark push predicates into it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The records under ``path``, only ``columns`` of them; partitions are as large as the
    session's file partitions."""
    register(spark)
    m = re.fullmatch(r"(\d+)([bkmg]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower())
    size = int(m[1]) << {"": 0, "b": 0, "k": 10, "m": 20, "g": 30}[m[2]] if m else PARTITION_BYTES
    source = spark.read.format("warc").option("partition_bytes", str(min(size, PARTITION_BYTES)))
    if columns is not None:
        source = source.schema(", ".join(c.strip() for c in re.split(r",\s*(?![^<]*>)", SCHEMA) if c.split()[0] in columns))
    return source.load(path)


# ---------------------------------------------------------------- pages as captures

def urn(id_: Column) -> Column:
    return F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(id_.cast("string")), F.lit(">")), F.lit("<urn:nopage>"))


def page_of(record_id: Column, kind: str) -> Column:
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:page:([^>]*)>$", 1), F.lit(""))).cast(kind)


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = LEAST_REVISIT,
             date: str = DATE, few: int = 200_000) -> DataFrame:
    """The records of a table of pages, one a row: of equal payloads of ``least`` bytes and more
    the one with the smallest id (null last, then url) is a response, the others revisit it;
    smaller payloads are all responses.  A null payload is empty.  Of rows that are the same in
    id, url and payload one is the response, and all have the same record id.

    Payloads are hashed where they are read; only ids, urls and digests of repeated payloads
    are grouped.  The rows that are no response are told apart by a broadcast if there are at
    most ``few`` of them, else by a shuffle join."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    src = src.select("id", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"), "payload")
    rows = write_table(src.where(F.col("bytes") >= least).groupBy("digest", "id", "url", "bytes").agg(F.count(F.lit(1)).alias("copies")), "warc-digests")
    order = F.struct(F.col("id").isNull().alias("a"), "id", F.col("url").isNull().alias("b"), "url")
    groups = rows.groupBy("digest").agg(F.min(order).alias("lead"), F.sum("copies").alias("n")).where(F.col("n") > 1)
    groups = write_table(groups.select("digest", "n", F.col("lead.id").alias("lead_id"), F.col("lead.url").alias("lead_url")), "warc-repeated")
    total = rows.agg(F.sum("copies")).first()[0] or 0
    again = join_groups(rows, groups, ["digest"], "n", total)
    first = F.col("id").eqNullSafe(F.col("lead_id")) & F.col("url").eqNullSafe(F.col("lead_url"))
    again = write_table(again.select("*", first.alias("first")), "warc-again")
    times = F.col("copies") - F.col("first").cast("bigint")
    revisits = again.where(times > 0).select("*", F.explode(F.sequence(F.lit(0), ((times - 1) / 1000).cast("bigint"))).alias("part"))
    revisits = revisits.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), times - F.col("part") * 1000))).alias("copy"))

    key = ["digest", "id", "url"]
    same = lambda other: [F.col(k).eqNullSafe(other[f"_{k}"]) for k in key]
    named = lambda df: df.select(*[F.col(k).alias(f"_{k}") for k in key])
    other = named(again.where(~F.col("first") | (F.col("copies") > 1)))
    small = other.limit(few + 1).count() <= few
    other = F.broadcast(other) if small else other
    sole = src.join(other, same(other), "left_anti")
    many = named(again.where(F.col("first") & (F.col("copies") > 1)))
    many = F.broadcast(many) if small else many
    one = src.join(many, same(many), "left_semi").groupBy(*key).agg(F.first("payload").alias("payload"), F.first("bytes").alias("bytes"))
    responses = sole.select(*key, "bytes", "payload").unionByName(one.select(*key, "bytes", "payload"))

    def shaped(df, kind, refers, body):
        return df.select(F.lit(kind).alias("warc_type"), urn(F.col("id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
                         F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), refers.alias("refers_to"), F.col("bytes").alias("payload_length"), body.alias("payload"))

    none = F.lit(None)
    return shaped(responses, "response", none.cast("string"), F.col("payload")).unionByName(
        shaped(revisits, "revisit", urn(F.col("lead_id")), none.cast("binary")))


def write(records: DataFrame, path: str, mode: str = "append") -> None:
    """Write records (columns of the source's schema that the format has a field for)."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).save(path)


def read_captures(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """What archives written from ``captures`` hold, one row a record: id, payload_bytes and
    payload_digest (of a response from the payload read, of a revisit from its header),
    record_type, refers_to.  Revisits are read without any payload."""
    got = read(spark, path, ["warc_type", "record_id", "payload"]).where(F.col("warc_type") == "response")
    full = got.select(page_of(F.col("record_id"), id_type).alias("id"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
                      F.sha2("payload", 256).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast(id_type).alias("refers_to"))
    got = read(spark, path, ["warc_type", "record_id", "payload_digest", "refers_to", "payload_length"]).where(F.col("warc_type") == "revisit")
    again = got.select(page_of(F.col("record_id"), id_type).alias("id"), F.col("payload_length").alias("payload_bytes"),
                       F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), F.lit("revisit").alias("record_type"),
                       page_of(F.col("refers_to"), id_type).alias("refers_to"))
    return full.unionByName(again)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Write the ``captures`` of ``pages`` under ``path`` and read them back: per row ``id_col``,
    payload_bytes, payload_digest, record_type, refers_to.  Other columns are ignored; an empty
    table gives an archive without records."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(captures(pages, id_col, url_col, text_col), path)
    return read_captures(spark, path, dict(pages.dtypes)[id_col]).withColumnRenamed("id", id_col)
