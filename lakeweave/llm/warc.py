"""WARC archives with an index by external merge.

Pages become WARC/1.1 records in files of the shared folder, one compressed member a record. Reading them back, each
file gives one run of index rows sorted by URL key and timestamp. Runs are merged by key ranges: a task gets its range
of every run and merges them with a loser tree into one part of the globally ordered capture history.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, new_path, written

#: Records that a file holds at most: a file is the unit of reading.
RECORDS = 4000
#: Index rows that a range of keys holds about, and rows of the sample for each range that ranges are cut from.
RANGE_ROWS, SAMPLED = 50_000, 20
#: Payload digests that occur more than once, up to which number they go to all tasks: 100 bytes each at most.
SENT = 100_000
EPOCH = 1_704_067_200  # captures are dated from 2024-01-01, one second a page_id
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "urlkey string, ts string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, at long, bytes long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """Host turned round, then path and query, in lower case: captures of one site stand together."""
    try:
        parts = urlsplit(url.strip().lower())
        host = ",".join(reversed((parts.hostname or "").removeprefix("www.").split(".")))
    except ValueError:
        return url.strip().lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "") if host else url.strip().lower()


def record(page_id: int | None, url: str | None, payload: bytes, hashed: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit, whose block is the response's headers alone."""
    import datetime

    when = datetime.datetime.fromtimestamp(EPOCH + (page_id or 0) % 3_000_000_000, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{hashed}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


_URL_SAFE = "".join(chr(c) for c in range(33, 127))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def members(stream) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes, record) of each compressed member of an open file, read a piece at a time."""
    at, rest = 0, b""
    while True:
        unzip, out, used = zlib.decompressobj(31), [], 0
        while not unzip.eof:
            if not rest:
                rest = stream.read(1 << 16)
                if not rest:
                    if used:
                        raise ValueError("the archive ends within a record")
                    return
            out.append(unzip.decompress(rest))
            used += len(rest) - len(unzip.unused_data)
            rest = unzip.unused_data
        yield at, used, b"".join(out)
        at += used


def _store(path: str):
    """The file system of a path, and the path there; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+://|file:", path) else (pafs.LocalFileSystem(), path)


def write(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row; (file, records) of the archives, in a written table.

    Of records with equal payloads that with the largest id is the response, others revisit it. A null payload is
    empty; a null id is never the largest unless it is alone. Rows that share the largest id are all responses. A
    task writes beside its files and renames, and a file's rows depend on the input alone, so a task that is run
    again after a lost executor leaves the same files.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("sha", F.sha1("html")).withColumn("size", F.octet_length("html"))
    latest = rows.groupBy(F.col("sha").alias("s"), F.col("size").alias("z")).agg(F.max("page_id").alias("latest"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    latest = written(latest, "warc-repeats")  # short: pages themselves go through no shuffle unless very many repeat
    latest = F.broadcast(latest) if latest.count() <= SENT else latest.hint("merge")
    rows = rows.join(latest, (F.col("sha") == F.col("s")) & (F.col("size") == F.col("z")), "left")
    rows = rows.select("page_id", "url", "html", F.when(F.col("page_id").eqNullSafe(F.col("latest")), None).otherwise(F.col("latest")).alias("refers_to"))
    store, base = _store(path)
    store.create_dir(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        part, number, out, n = TaskContext.get().partitionId(), 0, None, 0

        def close():
            out.close()
            store.move(f"{base}/{name}{temporary}", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{name}"]), pa.array([n], pa.int64())], ["file", "records"])

        temporary = f".{TaskContext.get().taskAttemptId()}.part"
        for b in batches:
            for page, url, html, refers in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{number:04d}.warc.gz"
                    out, n, number = store.open_output_stream(f"{base}/{name}{temporary}", compression=None), 0, number + 1
                zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
                out.write(zipped.compress(record(page, url, html, digest(html), refers)) + zipped.flush())
                n += 1
                if n == RECORDS:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return written(rows.transform(in_arrow, run, "file string, records long"), "warc-files")


def read(files: DataFrame) -> DataFrame:
    """The index rows of all archives: a sorted run for each file, with its name as `run` and places in it as `seq`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file in b.column("file").to_pylist():
                store, at = _store(file)
                rows = []
                with store.open_input_stream(at, compression=None) as f:
                    for offset, size, data in members(f):
                        rows.append(_indexed(*parse(data), file.rpartition("/")[2], offset, size))
                rows.sort(key=_order)
                names = [x.split()[0] for x in INDEX.split(", ")]
                cols = dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))
                kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array(range(len(rows)), pa.int64()), *(pa.array(cols[x], k) for x, k in zip(names, kinds, strict=True))], ["run", "seq", *names])

    n = max(1, min(files.count(), 100_000))
    return files.repartition(n).transform(in_arrow, run, f"run string, seq long, {INDEX}")


def _indexed(headers: dict[str, str], block: bytes, file: str, offset: int, size: int) -> tuple:
    """An index row from a record alone; a response's payload is hashed anew, and must be what its header says."""
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, hashed = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    size_said = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (digest(payload) != hashed or len(payload) != size_said):
        raise ValueError(f"the payload at {offset} of {file} is damaged")
    number = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    ts = re.sub(r"\D", "", headers["warc-date"])
    return url_key(headers["warc-target-uri"]) if "warc-target-uri" in headers else "", ts, number(headers["warc-record-id"]), kind, number(headers.get("warc-refers-to")), size_said, hashed, file, offset, size


def _order(row: tuple) -> tuple:
    return row[0].encode(), row[1], -1 if row[2] is None else row[2], row[7], row[8]


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """k-way merge of sorted runs by a loser tree: each match's loser stays at its node, so a new key plays log k matches."""
    k = len(runs)
    if not k:
        return
    at = [0] * k
    end = (b"\xff\xff\xff\xff\xff",)  # after every UTF-8 key
    key = [_order(r[0]) if r else end for r in runs]
    losers = [0] * k

    def play(node: int) -> int:
        """The winner below a node; losers are left at the inner nodes 1 to k - 1, and the runs stand at k to 2k - 1."""
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        win, lose = (a, b) if (key[a], a) <= (key[b], b) else (b, a)
        losers[node] = lose
        return win

    winner = play(1)
    while key[winner] is not end:
        yield runs[winner][at[winner]]
        at[winner] += 1
        key[winner] = _order(runs[winner][at[winner]]) if at[winner] < len(runs[winner]) else end
        node = (winner + k) // 2
        while node:
            if (key[losers[node]], losers[node]) < (key[winner], winner):
                losers[node], winner = winner, losers[node]
            node //= 2


def histories(runs: DataFrame) -> DataFrame:
    """The captures of all runs in global order by (urlkey, ts, page_id, file, at): column `position` counts from 0.

    Ranges of the whole order key, as many as the rows ask for, are cut from a sample of some rows for each, so a URL
    with very many captures falls into several ranges. A range's number comes with its rows in one shuffle; each task merges its part of every run.
    """
    spark = runs.sparkSession
    runs = written(runs, "warc-runs")
    total = runs.count()
    key = F.struct("urlkey", "ts", F.coalesce("page_id", F.lit(-1)).alias("page_id"), "file", "at")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS))
    every = max(1, total // (parts * SAMPLED))
    sample = runs.where(F.pmod(F.xxhash64("file", "at"), F.lit(every)) == 0).select(key.alias("k")).collect()
    keys = sorted(((r.k[0] or "").encode(), *tuple(r.k)[1:]) for r in sample)
    parts = min(parts, max(1, len(keys)))
    cuts = sorted({keys[i * len(keys) // parts] for i in range(1, parts)}) if keys else []
    sent = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import bisect

        for b in batches:
            names = ("urlkey", "ts", "page_id", "file", "at")
            rows = zip(*(b.column(x).to_pylist() for x in names), strict=True)
            to = [bisect.bisect_right(sent.value, (u.encode(), t, -1 if p is None else p, f, a)) for u, t, p, f, a in rows]
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *b.columns], ["part", *b.schema.names])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[str, list[tuple]] = {}
        part = None
        names = [x.split()[0] for x in INDEX.split(", ")]
        kinds = [pa.int64() if x.endswith("long") else pa.string() for x in INDEX.split(", ")]

        def out():
            got = list(merged(list(rows.values())))
            for a in range(0, len(got), 10_000):
                some = got[a : a + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array(range(a, a + len(some)), pa.int64()), *(pa.array(c, k) for c, k in zip(map(list, zip(*some, strict=True)), kinds, strict=True))], ["part", "place", *names])

        for b in batches:
            cols = (b.column(x).to_pylist() for x in ["part", "run", *names])
            for p, r, *row in zip(*cols, strict=True):
                if p != part and rows:
                    yield from out()
                    rows = {}
                part = p
                rows.setdefault(r, []).append(tuple(row))
        if rows:
            yield from out()

    dealt = runs.transform(in_arrow, deal, f"part int, run string, seq long, {INDEX}").repartitionById(len(cuts) + 1, "part").sortWithinPartitions("part", "run", "seq")
    done = written(dealt.transform(in_arrow, merge, f"part int, place long, {INDEX}"), "warc-index")
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    firsts = done.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("rows")).select("p", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    return done.join(firsts, F.col("part") == F.col("p")).select((F.col("first") + F.col("place")).alias("position"), *[x.split()[0] for x in INDEX.split(", ")])


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the pages' archives, reads them back and merges the index; see write() and histories(). Empty tables give no rows."""
    return histories(read(write(pages)))
