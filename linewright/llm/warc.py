"""WARC archives with a capture index merged from sorted runs."""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.llm.store import AttemptFile, open_input
from linewright.session import cut_lineage, fresh_path

#: Payloads below this many bytes are never written as revisits.
LEAST_PAYLOAD = 100
#: An archive file and its run of the index end at this many bytes or records.
FILE_BYTES = 64 << 20
FILE_RECORDS = 50_000
#: Index rows that one merge task takes.
MERGE_ROWS = 100_000
EPOCH = datetime(2000, 1, 1, tzinfo=timezone.utc)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RUN = (
    "run string, seq int, url_key string, ts string, page_id long, url string, record_type string, "
    "refers_to long, digest string, path string, offset long, length long"
)
INDEX = RUN + ", part int, place long"
BACK = "page_id long, record_type string, digest string, payload_bytes long, refers_to long, url_key string, ts string"

_URL = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::(\d*))?([^#]*)")


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels from the top domain down, then port, path and query."""
    match = _URL.match(url or "")
    if not match:
        return (url or "").strip()
    host, port, rest = match.groups()
    labels = host.lower().removeprefix("www.").split(".")
    place = ",".join(reversed(labels)) + (f":{port}" if port and port not in ("80", "443") else "")
    return f"{place}){rest or '/'}"


def capture_time(page_id: int | None) -> str:
    """The pages carry no time, so captures are a second apart in the order of their ids."""
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 32))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def _one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


class _Archive:
    """One file and the run of the index that belongs to it."""

    def __init__(self, folder: str):
        self.file = AttemptFile(folder, f"part-{TaskContext.get().partitionId():05d}", ".warc.gz")
        self.rows: list[dict] = []

    def add(self, page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> None:
        ts = capture_time(page_id)
        fields = [
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"),
            ("WARC-Date", ts),
            ("WARC-Target-URI", _one_line(url or "")),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Page-ID", "" if page_id is None else str(page_id)),
        ]
        if kind == "revisit":
            fields += [
                ("WARC-Profile", PROFILE),
                ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"),
                ("X-Refers-To-Page-ID", str(refers_to)),
            ]
            payload = b""
        else:
            fields.append(("Content-Type", "text/html; charset=utf-8"))
        offset = self.file.position
        self.file.write(gzip.compress(_record(kind, fields, payload), compresslevel=3, mtime=0))
        self.rows.append(
            {"url_key": url_key(url), "ts": ts, "page_id": page_id, "url": url, "record_type": kind,
             "refers_to": refers_to, "digest": digest, "path": self.file.address, "offset": offset,
             "length": self.file.position - offset}
        )

    def full(self) -> bool:
        return self.file.position >= FILE_BYTES or len(self.rows) >= FILE_RECORDS

    def finish(self) -> pa.RecordBatch:
        self.file.finish()
        self.rows.sort(key=lambda r: _place(r["url_key"], r["ts"], r["page_id"], r["offset"]))
        for seq, row in enumerate(self.rows):
            row |= {"run": self.file.name, "seq": seq}
        return pa.RecordBatch.from_pylist(self.rows, schema=_schema(RUN))


def _place(key: str, ts: str, page_id: int | None, offset: int) -> tuple:
    """Order of captures: key and time, then id with nulls first, then the place in the file."""
    return key.encode("utf-8"), ts, page_id is not None, page_id or 0, offset


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _write_archives(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, payload, digest, kind, refers_to = (v.as_py() for v in row)
                archive = archive or _Archive(folder)
                archive.add(page_id, url, payload, digest, kind, refers_to)
                if archive.full():
                    yield archive.finish()
                    archive = None
        if archive:
            yield archive.finish()

    return run


def decide(pages: DataFrame, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Adds payload, digest, record type and what a revisit refers to.

    Digests are counted before the shuffle, so a payload with a third of all pages is one row
    per task there. Only digests of more than one page come back to the pages.
    """
    hashed = pages.select(
        "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    first = (
        hashed.where(F.octet_length("payload") >= least_payload)
        .groupBy("digest")
        .agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > 1)
        .select("digest", "_first")
    )
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return hashed.join(first, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_warc(pages: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """Write a record per row and return the index runs, one sorted run per archive file.

    Records are compressed one by one, so each can be read at its offset. The runs are
    written out: the archives they name exist from then on and nothing writes them again.

    Needs ``page_id, url, html``. Null html is an empty payload, null urls have the key '';
    rows with the smallest id of their payload are all responses if that id repeats, and a
    null id is never the smallest. An empty table writes no file.
    """
    runs = decide(pages, least_payload).mapInArrow(_write_archives(folder), RUN)
    return cut_lineage(runs, "warc-runs")


class LoserTree:
    """Merges k sorted cursors; each step replays one path of about log2 k matches.

    An inner node holds the loser of its match and the root the winner over all. ``keys`` are
    the cursors' current keys, None for a cursor that has ended.
    """

    def __init__(self, keys: list):
        self.k = len(keys)
        self.keys = keys
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:
                self.tree[node] = i
                return
            if self._wins(other, i):
                self.tree[node], i = i, other
            node //= 2
        self.tree[0] = i

    def winner(self) -> int:
        return self.tree[0]

    def replace(self, key) -> None:
        """The winner's cursor has moved on to ``key``."""
        i = self.tree[0]
        self.keys[i] = key
        node = (i + self.k) // 2
        while node > 0:
            if self._wins(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i


def merge_runs(bounds: list[tuple[int, int]], key_at) -> Iterator[int]:
    """Row numbers of the sorted slices ``bounds`` in merged order."""
    cursors = [a for a, _ in bounds]
    if not cursors:
        return
    tree = LoserTree([key_at(a) for a in cursors])
    while tree.keys[i := tree.winner()] is not None:
        yield cursors[i]
        cursors[i] += 1
        tree.replace(key_at(cursors[i]) if cursors[i] < bounds[i][1] else None)


def _merge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    runs = rows.column("run").to_pylist()
    edges = [0, *[i for i in range(1, len(runs)) if runs[i] != runs[i - 1]], len(runs)]
    keys, times, ids, offsets = (rows.column(c).to_pylist() for c in ("url_key", "ts", "page_id", "offset"))
    order = list(
        merge_runs(list(zip(edges, edges[1:])), lambda i: _place(keys[i], times[i], ids[i], offsets[i]))
    )
    merged = rows.take(pa.array(order))
    n = merged.num_rows
    merged = merged.append_column("part", pa.array([TaskContext.get().partitionId()] * n, pa.int32()))
    yield from merged.append_column("place", pa.array(range(n), pa.int64())).to_batches()


def merge_index(runs: DataFrame, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """One capture index in the order of URL key and time out of all runs.

    The key space is cut into ranges of about ``merge_rows`` rows; a range takes a slice out
    of every run, each still sorted, and a loser tree merges the slices. Order is (``part``,
    ``place``): a URL's captures stand together, earliest first. Ranges go by key, time and
    id, so the captures of one URL may be cut over several ranges.
    """
    ranges = max(1, -(-runs.count() // merge_rows))
    sliced = runs.repartitionByRange(
        ranges, "url_key", "ts", F.col("page_id").asc_nulls_first()
    ).sortWithinPartitions("run", "seq")
    return cut_lineage(sliced.mapInArrow(_merge_batches, INDEX), "warc-index")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, file = None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["path"] != path:
                if file:
                    file.close()
                path, file = row["path"], open_input(row["path"])
            file.seek(row["offset"])
            fields, block = parse_record(gzip.decompress(file.read(row["length"])))
            kind = fields["WARC-Type"]
            stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            if kind == "response" and hashlib.sha256(block).hexdigest() != stated:
                raise ValueError(f"payload and digest differ: {row['path']} at {row['offset']}")
            refers_to, page_id = fields.get("X-Refers-To-Page-ID"), fields["X-Page-ID"]
            out.append(
                {"page_id": int(page_id) if page_id else None, "record_type": kind, "digest": stated,
                 "payload_bytes": len(block) if kind == "response" else None,
                 "refers_to": int(refers_to) if refers_to else None, "url_key": row["url_key"], "ts": row["ts"]}
            )
        yield pa.RecordBatch.from_pylist(out, schema=_schema(BACK))


def read_warc(index: DataFrame) -> DataFrame:
    """Every record that the index names, read from the archives.

    A task takes whole files and reads them in the order of their offsets. The size of a
    revisit's payload is that of the response with its digest, one row per
    digest on that side of the join.
    """
    places = index.select("path", "offset", "length", "url_key", "ts")
    back = places.repartition(F.col("path")).sortWithinPartitions("path", "offset").mapInArrow(_read_batches, BACK)
    back = cut_lineage(back, "warc-back")
    sizes = (
        back.where("record_type = 'response'").groupBy("digest").agg(F.max("payload_bytes").alias("_size"))
        .join(back.where("record_type = 'revisit'").select("digest").distinct(), "digest", "left_semi")
    )
    return back.join(sizes, "digest", "left").select(
        "page_id", F.coalesce("payload_bytes", "_size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url_key", "ts",
    )



ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
f AS (SELECT body, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY body)
SELECT p.page_id, p.n AS payload_bytes, sha256(p.body) AS payload_digest,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first IS NOT NULL AND p.page_id IS DISTINCT FROM f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.body = f.body AND p.n >= 100
"""


@query("op10_warc", ORACLE)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    runs = write_warc(table(spark, sf_dir, "pages"), folder)
    back = read_warc(merge_index(runs))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
