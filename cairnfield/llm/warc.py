"""WARC archives with a two-level capture index, written and read by Spark."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import pieces, shared_dir

SEGMENT = 4 << 20
LINES = 256
SMALLEST_REVISITED = 100
#: Bytes of records in one row of a segment: what a range read fetches at least.
CHUNK = 256 << 10
_SCHEMA = "kind string, name string, part int, first_key string, n long, at long, data binary"
_ARROW = pa.schema([("kind", pa.string()), ("name", pa.string()), ("part", pa.int32()), ("first_key", pa.string()), ("n", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])


def surt(url: Column) -> Column:
    """The index key: host reversed by label, lower case, without user, port and leading www; then the rest.

    Control characters and blanks become %XX, so that keys sort as they are stored. A null is ''."""
    whole = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s+|\s+$", "")
    whole = F.regexp_replace(whole, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?", "")
    host, rest = F.regexp_extract(whole, r"^[^/?#]*", 0), F.regexp_replace(whole, r"^[^/?#]*", "")
    host = F.lower(F.regexp_replace(host, r"(?s)^.*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"^www\d*\.", "")
    rest = F.substring_index(rest, "#", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))
    escapes = F.array(*[F.struct(F.lit(chr(c)).alias("raw"), F.lit(f"%{c:02X}").alias("escaped")) for c in (*range(33), 127)])
    return F.when(key.rlike(r"[\x00-\x20\x7f]"), F.aggregate(escapes, key, lambda k, e: F.replace(k, e["raw"], e["escaped"]))).otherwise(key)


def _one_line(s: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", s)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds the response head only."""
    kind = "response" if refers_to is None else "revisit"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Target-URI: {_one_line(url or '')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + z.flush()


def records(data: bytes) -> Iterator[dict]:
    """Parse a segment: headers in lower case, ``payload``, ``payload_bytes`` and ``offset`` of each record."""
    at, view = 0, memoryview(data)
    while at < len(data):
        z, parts, to = zlib.decompressobj(31), [], at
        while not z.eof:
            parts.append(z.decompress(view[to : to + 16384]))
            to += len(view[to : to + 16384])
        raw, used = b"".join(parts), to - len(z.unused_data) - at
        head, _, rest = raw.partition(b"\r\n\r\n")
        out: dict = dict(x.decode().partition(": ")[::2] for x in head.split(b"\r\n")[1:])
        out = {k.lower(): v for k, v in out.items()}
        block = rest[: int(out["content-length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
        yield out | {"payload": payload, "payload_bytes": size, "offset": at, "length": used}
        at += used


def revisits(pages: DataFrame, salts: int = 16) -> DataFrame:
    """(page_id, url, digest, refers_to) of pages whose payload a page with a smaller id has."""
    bytes_ = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    thin = pages.select("page_id", "url", F.sha2(bytes_, 256).alias("digest"), F.length(bytes_).alias("n")).where((F.col("n") >= SMALLEST_REVISITED) & F.col("page_id").isNotNull())
    firsts = thin.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("last > refers_to").select("digest", "refers_to")
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = thin.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    return salted.join(firsts, ["digest", "salt"]).where("page_id > refers_to").select("page_id", "url", "digest", "refers_to").distinct()


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Write ``pages`` (page_id, url, html) as WARC segments with their capture index; returns the path.

    Pages are range-partitioned and sorted by reversed-host key. A task packs records (gzip
    members) into segments of about SEGMENT bytes, stored in rows of about CHUNK bytes that can be read
    alone, and index lines into compressed blocks of LINES; ``directory`` keeps the first key of each block only. All goes through Spark's writers, so any
    shared store will do, and a lost executor's task is simply run again.

    Null html is an empty payload; a null url has key ``)/``; rows with a null id are responses.
    Repeated ids are written once a row. Columns besides the three are not read.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/cairnfield-warc-{uuid.uuid4().hex}"
    rows = pages.select("page_id", "url", "html")
    again = revisits(rows)
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    rows = rows.select("page_id", "url", "html", digest.alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.lit(True).alias("page"))
    # thin rows that say what a page revisits travel to it in the same shuffle and come just before it
    rows = rows.unionByName(again.withColumns({"html": F.lit(None).cast("string"), "page": F.lit(False)}))
    rows = rows.withColumn("key", surt(F.col("url"))).repartitionByRange("key", F.col("page_id").asc_nulls_first()).sortWithinPartitions("key", "page_id", "page")

    def pack(batches):
        from pyspark import TaskContext

        part, seg, at, buf, size, lines, blocks = TaskContext.get().partitionId(), 0, 0, [], 0, [], 0

        def out(kind, name, first, n, at, data):
            return pa.RecordBatch.from_pylist([{"kind": kind, "name": name, "part": part, "first_key": first, "n": n, "at": at, "data": data}], _ARROW)

        def block():
            return out("block", f"{part:06d}-{blocks:06d}", lines[0].split(" ")[0], len(lines), None, zlib.compress("\n".join(lines).encode(), 6))

        def chunk():
            return out("segment", f"{part:06d}-{seg:06d}", first_of_chunk, len(buf), at, b"".join(buf))

        first_of_chunk = ""
        told: tuple[int | None, dict[str, int]] = (None, {})
        for b in pieces(batches, "html"):
            for r in b.to_pylist():
                if not r["page"]:
                    told = (r["page_id"], (told[1] if told[0] == r["page_id"] else {}) | {r["digest"]: r["refers_to"]})
                    continue
                if r["page_id"] is not None and told[0] == r["page_id"]:
                    r["refers_to"] = told[1].get(r["digest"])
                data = record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), r["digest"], r["refers_to"])
                if not buf:
                    first_of_chunk = r["key"]
                lines.append(f"{r['key']} {'null' if r['page_id'] is None else r['page_id']} {part:06d}-{seg:06d} {at} {size} {len(data)}")
                buf.append(data)
                size += len(data)
                if len(lines) >= LINES:
                    yield block()
                    lines, blocks = [], blocks + 1
                if size >= CHUNK:
                    yield chunk()
                    at, buf, size = at + size, [], 0
                    if at >= SEGMENT:
                        seg, at = seg + 1, 0
        if buf:
            yield chunk()
        if lines:
            yield block()

    rows.select("page_id", "url", "html", "digest", "refers_to", "key", "page").mapInArrow(pack, _SCHEMA).write.partitionBy("kind").parquet(f"{path}/archive")
    _archive(spark, path, "block").select("name", "part", "first_key").write.parquet(f"{path}/directory")
    return path


def _archive(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(f"{path}/archive").where(F.col("kind") == kind)


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def _fields(r: dict) -> dict:
    number = lambda s: None if s is None or "null" in s else int(s[len("<urn:page:") : -1])
    full = r["warc-type"] == "response"
    return {
        "page_id": number(r["warc-record-id"]), "url": r["warc-target-uri"], "payload_bytes": len(r["payload"]) if full else r["payload_bytes"],
        "payload_digest": hashlib.sha256(r["payload"]).hexdigest() if full else r["warc-payload-digest"].removeprefix("sha256:"),
        "record_type": r["warc-type"], "refers_to": number(r.get("warc-refers-to")), "html": r["payload"].decode("utf-8", "surrogatepass") if full else None,
    }


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Read every record without the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html.

    The digest of a response is computed from the payload read; a revisit's is the one it names. A
    null url comes back as '' and null html as ''; a revisit has no html; null ids stay null."""

    def parse(batches):
        for b in batches:
            for data in b.column(0):
                yield pa.RecordBatch.from_pylist([_fields(r) for r in records(data.as_py())], _RECORD_ARROW)

    return _archive(spark, path, "segment").select("data").mapInArrow(parse, _RECORD)


def lookup(spark: SparkSession, path: str, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """All captures of the urls (each key once), as ``read_archive`` gives them, found through the index.

    1. A wanted key's parts (tasks of the writer, whose first keys are broadcast: one row a task) and,
       with the part's directory lines, its blocks are found by binary search.
    2. Only these blocks are read, decompressed and searched; their lines name segment, row and range.
    3. Only the rows of segments that hold such ranges are read, and only the ranges are decompressed.

    Null urls ask for key ``)/``; repeated urls give each capture once; no urls or no pages give no rows."""
    directory, blocks = spark.read.parquet(f"{path}/directory"), _archive(spark, path, "block").select("name", "part", "first_key", "data")
    firsts = directory.groupBy("part").agg(F.min("first_key").alias("k")).orderBy("k", "part").collect()
    parts, keys = [r["part"] for r in firsts], [r["k"] for r in firsts]
    wanted = urls.select(surt(F.col(url_col)).alias("key")).distinct()

    def between(sorted_keys, key):
        """Entries that may hold ``key``: from the last that begins before it to the last that begins with it."""
        return range(max(0, bisect_left(sorted_keys, key) - 1), bisect_right(sorted_keys, key))

    def place(batches):
        for b in batches:
            rows = [(parts[i], k) for k in b.column(0).to_pylist() for i in between(keys, k)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([k for _, k in rows], pa.string())], ["part", "key"])

    def search(left, right):
        right = right.sort_by([("first_key", "ascending"), ("name", "ascending")])
        names, begins = right.column("name").to_pylist(), right.column("first_key").to_pylist()
        rows = [(names[i], k) for k in left.column("key").to_pylist() for i in between(begins, k)]
        return pa.table({"part": pa.array(right.column("part").to_pylist()[:1] * len(rows), pa.int32()), "name": pa.array([n for n, _ in rows], pa.string()), "key": pa.array([k for _, k in rows], pa.string())})

    def lines(left, right):
        data, out, asked = dict(zip(right.column("name").to_pylist(), right.column("data"), strict=True)), [], {}
        for n, k in zip(left.column("name").to_pylist(), left.column("key").to_pylist(), strict=True):
            asked.setdefault(n, []).append(k)
        for n, ks in asked.items():
            held = zlib.decompress(data[n].as_py()).decode().split("\n")
            for k in ks:
                i = bisect_left(held, k + " ")
                while i < len(held) and held[i].startswith(k + " "):
                    out.append(held[i].rsplit(" ", 5)[2:])
                    i += 1
        return pa.table({"name": pa.array([x[0] for x in out], pa.string())} | {c: pa.array([int(x[j]) for x in out], pa.int64()) for j, c in ((1, "at"), (2, "offset"), (3, "size"))})

    hits = wanted.mapInArrow(place, "part int, key string").groupBy("part").cogroup(directory.groupBy("part")).applyInArrow(search, "part int, name string, key string")
    used = blocks.join(hits.select("name").distinct(), "name", "left_semi")
    found = hits.groupBy("part").cogroup(used.groupBy("part")).applyInArrow(lines, "name string, at long, offset long, size long")
    ranges = found.groupBy("name", "at").agg(F.collect_list(F.struct("offset", "size")).alias("ranges"))  # no more than a row's records

    def read(batches):
        for b in batches:
            for data, rs in zip(b.column(0), b.column(1), strict=True):
                view = data.as_buffer()
                got = [r for x in rs.as_py() for r in records(view.slice(x["offset"], x["size"]).to_pybytes())]
                yield pa.RecordBatch.from_pylist([_fields(r) for r in got], _RECORD_ARROW)

    return _archive(spark, path, "segment").select("name", "at", "data").join(ranges, ["name", "at"]).select("data", "ranges").mapInArrow(read, _RECORD)
