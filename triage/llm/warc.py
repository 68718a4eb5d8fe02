"""Operator 7: WARC archives with an externally merged capture index.

1. Payload digests of all pages; of pages with equal payloads of REVISIT bytes
   or more the largest page_id is the response that the others revisit.
2. Each task writes its pages to archives, one gzip member a record, and for
   every archive a run: its captures sorted by URL key, timestamp and page.
3. Runs are merged by a loser tree, FAN_IN at a time; the last pass is dealt
   to tasks by key ranges, whose bounds come from SAMPLE_KEYS sampled keys (a
   bound of the bounds' choice only). Runs are read in order with a sparse
   index, so memory stays with FAN_IN open lines whatever the size.
4. Archives are read back record by record, digests verified.

Files are written under another name and renamed: repeated tasks are harmless.

Defined results: null html is an empty payload (a response); a null URL has key
"-"; a null page_id revisits the largest id of its payload, and is a response
where there is none; rows of one id and payload are all responses or all
revisits; an empty table writes nothing and gives an empty result; extra
columns are ignored. Without a capture time the page_id counts seconds.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from itertools import islice
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triage.llm.common import scratch_path, stored
from triage.llm.tokenfile import _open, put

REVISIT = 1000
ARCHIVE_BYTES, FAN_IN, SPARSE, SAMPLE_KEYS, GZIP = 1 << 28, 64, 64, 8192, 4
_HISTORY = "urlkey string, ts string, page_id long, file string, offset long, length long"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:page")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; no scheme, www., default port or fragment."""
    if not url:
        return "-"
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return quote(url, safe="/:?&=%#.,)-_~+@!*;")
    if not host:
        return quote(url, safe="/:?&=%#.,)-_~+@!*;")
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")"
    return quote(key + (u.path or "/") + (f"?{u.query}" if u.query else ""), safe="/:?&=%#.,)-_~+@!*;")


def record(page_id, url, html: bytes, refers_to, when: str) -> bytes:
    """A response or revisit record, as one gzip member."""
    sha = base64.b32encode(hashlib.sha1(html).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    name = f"{page_id}" if page_id is not None else f"{url}-{sha}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>", f"WARC-Date: {when}"]
    if url:
        head.append("WARC-Target-URI: " + quote(url, safe="/:?&=%#.,()-_~+@!*;$'[]"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{sha}")
    if refers_to is None:
        block += html
    else:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(_SPACE, str(refers_to))}>", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    squeeze = zlib.compressobj(GZIP, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def members(stream, step: int = 1 << 20):
    """(offset, bytes) of each gzip member of a stream."""
    at, left, open_ = 0, b"", None
    while True:
        data = left or stream.read(step)
        if not data:
            if open_ is not None:
                raise ValueError("the archive ends within a record")
            return
        if open_ is None:
            open_, parts, begin = zlib.decompressobj(31), [], at
        parts.append(open_.decompress(data))
        left = open_.unused_data
        at += len(data) - len(left)
        if open_.eof:
            yield begin, b"".join(parts)
            open_ = None


def parse(raw: bytes) -> dict:
    """Fields of a record: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(field["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(field["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if field["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of page {field.get('X-Page-ID')} is damaged")
    number = lambda k: int(field[k]) if k in field else None
    return {"page_id": number("X-Page-ID"), "payload_bytes": size, "payload_digest": digest, "record_type": field["WARC-Type"], "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


# -- runs -----------------------------------------------------------------


def sort_key(c: tuple) -> tuple:
    """Order of captures (urlkey, ts, page_id, file, offset, length); no page_id comes first."""
    return (c[0], c[1], c[2] is not None, c[2] or 0, c[3], c[4])


def _line(c: tuple) -> bytes:
    return "\t".join("" if x is None else str(x) for x in c).encode() + b"\n"


def _capture(line: bytes) -> tuple:
    k, ts, page, file, offset, length = line.decode().rstrip("\n").split("\t")
    return k, ts, int(page) if page else None, file, int(offset), int(length)


class RunWriter:
    """A run: sorted captures as lines, and beside them the first of every SPARSE lines with its place; visible once closed."""

    def __init__(self, uri: str):
        self.uri, (self.system, self.path) = uri, _open(uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.other = f"{self.path}.{uuid.uuid4().hex}.part"
        self.file = self.system.open_output_stream(self.other, compression=None)
        self.sparse, self.n, self.at = [], 0, 0

    def add(self, captures) -> None:
        lines = []
        for c in captures:
            line = _line(c)
            if self.n % SPARSE == 0:
                self.sparse.append(b"%d\t" % self.at + line)
            self.n, self.at = self.n + 1, self.at + len(line)
            lines.append(line)
        self.file.write(b"".join(lines))

    def close(self) -> int:
        self.file.close()
        put(self.uri + ".idx", self.sparse)
        self.system.move(self.other, self.path)
        return self.n


def write_run(uri: str, captures) -> int:
    run, captures = RunWriter(uri), iter(captures)
    while part := list(islice(captures, 4096)):
        run.add(part)
    return run.close()


def read_run(uri: str, low=None, high=None, step: int = 1 << 16):
    """Captures of a run with low <= key < high, in order, read from the place that the sparse index names."""
    system, path = _open(uri)
    begin = 0
    if low is not None:
        with system.open_input_stream(path + ".idx", compression=None) as f:
            for line in f.readall().splitlines():
                place, _, rest = line.partition(b"\t")
                if sort_key(_capture(rest)) > low:
                    break
                begin = int(place)
    with system.open_input_file(path) as f:
        f.seek(begin)
        left = b""
        while data := f.read(step):
            lines = (left + data).split(b"\n")
            left = lines.pop()
            for line in lines:
                c = _capture(line)
                key = sort_key(c)
                if high is not None and key >= high:
                    return
                if low is None or key >= low:
                    yield c


class LoserTree:
    """Merges k sorted iterators; each step replays one path of log2(k) matches against the losers kept there."""

    def __init__(self, sources, key=sort_key):
        self.sources, self.key = [iter(s) for s in sources], key
        self.k = max(1, len(self.sources))
        self.heads = [None] * self.k
        self.keys = [None] * self.k
        for i in range(len(self.sources)):
            self._draw(i)
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _draw(self, i: int) -> None:
        self.heads[i] = next(self.sources[i], None) if i < len(self.sources) else None
        self.keys[i] = None if self.heads[i] is None else self.key(self.heads[i])

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        """Winner of the matches below a node (leaves are k to 2k - 1); losers stay at their nodes."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._beats(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.heads[w := self.winner] is not None:
            yield self.heads[w]
            self._draw(w)
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


# -- Spark ----------------------------------------------------------------


def _write(folder: str):
    def run(batches):
        task, nth, captures, at = TaskContext.get().partitionId(), 0, [], 0
        name, rows, done = f"archive-{task:07d}-%05d.warc.gz", [], []

        def close():
            nonlocal nth, captures, at, rows
            file = name % nth
            put(f"{folder}/{file}", rows)
            ordered = sorted(((k, ts, p, file, o, n) for k, ts, p, o, n in captures), key=sort_key)
            run_name = f"run-{task:07d}-{nth:05d}.cdx"
            write_run(f"{folder}/runs/{run_name}", ordered)
            step = max(1, len(ordered) // 16)
            done.append((file, run_name, len(ordered), ["\t".join(map(str, x)) for x in ((c[0], c[1], "" if c[2] is None else c[2], c[3], c[4], c[5]) for c in ordered[step // 2 :: step])]))
            nth, captures, at, rows = nth + 1, [], 0, []

        for batch in batches:
            for page, url, html, refers, when in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = record(page, url, (html or "").encode(), refers, when)
                captures.append((url_key(url), "".join(c for c in when if c.isdigit()), page, at, len(member)))
                rows.append(member)
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    close()
        if rows:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["file", "run", "n", "sample"])

    return run


def write_archives(pages: DataFrame, folder: str, when: str | None = None) -> DataFrame:
    """Writes pages (page_id, url, html, and the ISO time column named by `when`); returns a row for each archive and run."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    time = F.col(when) if when else F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(3_000_000_000))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), time.alias("captured"))
    long = F.length(html) >= REVISIT
    digest = F.when(long, F.sha1(html))
    same = rows.select("page_id", digest.alias("same")).filter("same is not null").groupBy("same").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
    same = stored(same.filter("n > 1").select("same", "response"), "responses")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("response")), None).otherwise(F.col("response"))
    ready = rows.withColumn("digest", digest).join(same, F.col("digest") == F.col("same"), "left").select("page_id", "url", "html", refers.alias("refers_to"), "captured")
    return stored(ready.mapInArrow(_write(folder), "file string, run string, n long, sample array<string>"), "archives")


def _merge_group(folder: str, level: int):
    def run(table: pa.Table) -> pa.Table:
        names, group = sorted(table.column("run").to_pylist()), table.column("group")[0].as_py()
        name = f"merged-{level:02d}-{group:07d}.cdx"
        n = write_run(f"{folder}/runs/{name}", LoserTree([read_run(f"{folder}/runs/{x}") for x in names]))
        return pa.table({"run": [name], "n": [n]})

    return run


def _merge_range(folder: str, runs: list[str], bounds: list[str]):
    limits = [None, *[sort_key(_capture(b.encode())) for b in bounds], None]

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                tree = iter(LoserTree([read_run(f"{folder}/runs/{x}", limits[i], limits[i + 1]) for x in runs]))
                # The shard's file is written as the merge goes, and its captures follow in batches: a range is never held whole.
                shard = RunWriter(f"{folder}/index/part-{i:05d}.cdx")
                while part := list(islice(tree, 8192)):
                    first = shard.n
                    shard.add(part)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(part), pa.int32()), pa.array(range(first, first + len(part)), pa.int64()), *[pa.array(x) if k not in (2,) else pa.array(x, pa.int64()) for k, x in enumerate(zip(*part, strict=True))]],
                        ["range", "nth", "urlkey", "ts", "page_id", "file", "offset", "length"],
                    )
                shard.close()

    return run


def merge_index(spark: SparkSession, archives: DataFrame, folder: str) -> DataFrame:
    """Global capture history: range, nth within it, urlkey, ts, page_id, file, offset, length; also written as index shards."""
    runs, level = archives.select("run"), 0
    while (n := runs.count()) > FAN_IN:
        grouped = runs.withColumn("group", ((F.row_number().over(Window.orderBy("run")) - 1) / FAN_IN).cast("int"))
        runs, level = stored(grouped.groupBy("group").applyInArrow(_merge_group(folder, level), "run string, n long").select("run"), "runs"), level + 1
    names = sorted(r[0] for r in runs.collect())  # FAN_IN at most
    keys = archives.select(F.explode("sample").alias("k")).orderBy(F.xxhash64("k"), "k").limit(SAMPLE_KEYS)
    keys = sorted((r[0] for r in keys.collect()), key=lambda k: sort_key(_capture(k.encode())))
    total = archives.agg(F.sum("n")).collect()[0][0] or 0
    parts = max(1, min(len(keys), total // 2000, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)] if n else []
    bounds = list(dict.fromkeys(bounds))
    ranges = spark.range(0, len(bounds) + 1, 1, len(bounds) + 1)
    return stored(ranges.mapInArrow(_merge_range(folder, names, bounds), "range int, nth long, " + _HISTORY), "history")


def _read(folder: str):
    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = _open(f"{folder}/{file}")
                out = []
                with system.open_input_stream(path, compression=None) as f:
                    for offset, raw in members(f):
                        r = parse(raw)
                        out.append((file, offset, r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
                        if len(out) == 4096:
                            yield _records(out)
                            out = []
                if out:
                    yield _records(out)

    return run


def _records(rows) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "offset", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: file, offset, page_id, payload_bytes, payload_digest, record_type, refers_to."""
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("file").repartition(parts, "file").mapInArrow(_read(folder), "file string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Per page what its record says, read back from the archive and offset that the merged capture history names."""
    folder = scratch_path(spark, "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    # The history grows with the pages: it is joined by a shuffle, whatever its stored size.
    history = merge_index(spark, archives, folder).select(F.col("file").alias("f"), F.col("offset").alias("o")).hint("merge")
    records = read_archives(archives, folder)
    return records.join(history, (F.col("file") == F.col("f")) & (F.col("offset") == F.col("o"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
