"""Product codes of vectors by Lloyd rounds over partition-local cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.llm.vectors import one_length, scaled, square_distances, usable
from linewright.session import cut_lineage, drop_folder, fresh_path

#: Rows under one tree. The distances between its points are held at once: 32 MB.
TREE_ROWS = 2048
#: Bounds are computed in doubles; what is this close counts as ambiguous.
SLACK = 1e-9

_INT = np.dtype("<i4")
_LONG = np.dtype("<i8")


@dataclass
class CoverTree:
    """Distinct points, ordered so that the points below a node are a slice ``lo:hi``.

    ``sums`` and ``counts`` run over that order with the rows of each point, so the sum and the
    number of rows below a node are a difference of two entries.
    """

    points: np.ndarray  # (n, d), in tree order
    counts: np.ndarray  # rows up to each point, n + 1
    sums: np.ndarray  # component sums up to each point, (n + 1, d)
    center: np.ndarray  # place of each node's centre
    radius: np.ndarray  # no point below the node is farther from its centre
    lo: np.ndarray
    hi: np.ndarray
    first: np.ndarray  # children are the nodes first:last
    last: np.ndarray
    place: np.ndarray  # row -> place of its point

    @classmethod
    def build(cls, rows: np.ndarray) -> CoverTree:
        """A node's children cover its points at half the node's scale, which is a power of two.
        The centre is the first child's centre too, and the centres of siblings are farther
        apart than the children's scale. Scales at which nothing parts are left out."""
        points, inverse, copies = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        far = np.sqrt(square_distances(points, points).astype(np.float64))
        order = np.arange(len(points))
        center, lo, hi = [0], [0], [len(points)]
        radius, first, last = [], [], []
        node = 0
        while node < len(center):
            a, b, c = lo[node], hi[node], center[node]
            left = order[a:b].copy()
            reach = float(far[c, left].max())
            radius.append(reach)
            first.append(len(center))
            if reach > 0:
                half = 2.0 ** (math.ceil(math.log2(reach)) - 1)
                q = c
                while len(left):
                    near = far[q, left] <= half
                    group = left[near]
                    order[a : a + len(group)] = group
                    center.append(q)
                    lo.append(a)
                    a += len(group)
                    hi.append(a)
                    left = left[~near]
                    q = left[0] if len(left) else -1
            last.append(len(center))
            node += 1
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        return cls.restored(
            points[order], copies[order], place[np.array(center)], np.array(radius), np.array(lo), np.array(hi),
            np.array(first), np.array(last), place[inverse.reshape(-1)],
        )

    @classmethod
    def restored(cls, points, copies, center, radius, lo, hi, first, last, place) -> CoverTree:
        points = points.astype(np.int64)
        counts = np.concatenate([[0], np.cumsum(copies)])
        sums = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points * copies[:, None], axis=0)])
        return cls(points, counts, sums, center, radius, lo, hi, first, last, place)

    def packed(self) -> dict:
        parts = {"points": _INT, "copies": _INT, "center": _INT, "radius": np.dtype("<f8"), "lo": _INT, "hi": _INT,
                 "first": _INT, "last": _INT, "place": _INT}
        return {n: np.ascontiguousarray(getattr(self, n), dtype=t).tobytes() for n, t in parts.items()}

    @property
    def copies(self) -> np.ndarray:
        return np.diff(self.counts)

    @classmethod
    def unpacked(cls, packed: dict, width: int) -> CoverTree:
        ints = {n: np.frombuffer(packed[n], _INT).astype(np.int64) for n in packed if n != "radius"}
        return cls.restored(
            ints["points"].reshape(-1, width), ints["copies"], ints["center"], np.frombuffer(packed["radius"], "<f8"),
            ints["lo"], ints["hi"], ints["first"], ints["last"], ints["place"],
        )

    def assign(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that go to one entry as a whole, as ``lo, hi, entry`` by ``lo``.

        With the nearest entry at ``a`` from a node's centre, the second at ``b``, and every point
        within ``r``: points are at most ``a + r`` from the first and at least ``b - r`` from all
        others, so ``b - a > 2 r`` settles the subtree. A node of one point is compared exactly,
        ties to the lower index; all others hand their children on.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        front = np.zeros(1, np.int64)
        while len(front):
            squares = square_distances(self.points[self.center[front]], entries)
            nearest = squares.argmin(axis=1)
            settled = self.radius[front] == 0
            if squares.shape[1] > 1:
                two = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
                settled |= two[:, 1] - two[:, 0] > 2 * self.radius[front] + SLACK * (1 + two[:, 1])
            else:
                settled[:] = True
            whole = front[settled]
            done.append((self.lo[whole], self.hi[whole], nearest[settled]))
            open_nodes = front[~settled]
            sizes = self.last[open_nodes] - self.first[open_nodes]
            starts = np.repeat(self.first[open_nodes] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(sizes) else sizes
            front = starts + np.arange(len(starts))
        lo, hi, entry = (np.concatenate(x) for x in zip(*done))
        by_place = np.argsort(lo)
        return lo[by_place], hi[by_place], entry[by_place]


_TREE = "array<struct<points:binary,copies:binary,center:binary,radius:binary,lo:binary,hi:binary,first:binary,last:binary,place:binary>>"


def _tree_batches(parts: int, width: int):
    """Chunks of rows as trees, one per part of the vector, next to the ids and groups of the rows."""
    d = width // parts

    def chunk(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        n = rows.num_rows
        numbers = np.asarray(rows.column("_v").combine_chunks().flatten()).reshape(n, width)
        trees = [CoverTree.build(numbers[:, p * d : (p + 1) * d]).packed() for p in range(parts)]
        whole = pa.array([0, n], pa.int32())
        lists = [pa.ListArray.from_arrays(whole, rows.column(c).combine_chunks()) for c in ("_id", "_group")]
        fields = pa.struct([(name, pa.binary()) for name in trees[0]])
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(fields))], names=["ids", "groups", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = 0
        for batch in batches:
            while batch.num_rows:
                waiting.append(batch.slice(0, TREE_ROWS - held))
                held += waiting[-1].num_rows
                batch = batch.slice(waiting[-1].num_rows)
                if held == TREE_ROWS:
                    yield chunk(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
        if held:
            yield chunk(pa.Table.from_batches(waiting))

    return run


def _sum_batches(books: np.ndarray):
    """What each entry of each part gains in a task, one row per entry."""
    parts, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, packed in enumerate(trees.as_py()):
                    tree = CoverTree.unpacked(packed, d)
                    lo, hi, entry = tree.assign(books[p])
                    np.add.at(counts[p], entry, tree.counts[hi] - tree.counts[lo])
                    np.add.at(sums[p], entry, tree.sums[hi] - tree.sums[lo])
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    return run


def _code_batches(books: np.ndarray):
    parts, _, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                codes, error = [], 0
                for p, packed in enumerate(batch.column(2)[i].as_py()):
                    tree = CoverTree.unpacked(packed, d)
                    lo, hi, entry = tree.assign(books[p])
                    of_point = np.repeat(entry, hi - lo)
                    off = ((tree.points - books[p][of_point]) ** 2).sum(axis=1)
                    codes.append(of_point[tree.place])
                    error = error + off[tree.place]
                n = len(error)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, 1).flatten(),
                        batch.column(1).slice(i, 1).flatten(),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, parts * n + 1, parts), pa.int32()),
                            pa.array(np.stack(codes, axis=1).reshape(-1), pa.int32()),
                        ),
                        pa.array(error, pa.int64()),
                    ],
                    names=["_id", "_group", "code", "error"],
                )

    return run


def next_books(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """One Lloyd round: each entry becomes the floor of the mean of its parts, unused ones stay.

    A task gives one row per entry, so what is shuffled and what reaches the driver is bounded
    by the size of the codebooks, however many rows there are and however many share an entry.
    """
    d = books.shape[2]
    gained = trees.select("trees").mapInArrow(_sum_batches(books), "part int, entry int, n long, sums array<long>")
    totals = gained.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(d)])
    books = books.copy()
    for row in totals.collect():
        books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(d)]
    return books


def product_codes(
    vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", group: str = "label",
    scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, np.ndarray]:
    """Rows ``id, group, code array<int>, error long``, and the codebooks ``[part, entry, position]``.

    Components become ``floor(scale * x)``; vectors are cut into ``parts`` equal parts. The
    codebook of a part begins as that part of the first ``entries`` rows by id and goes through
    ``rounds`` Lloyd rounds. Ties go to the lower index.

    Tasks build their trees once, over at most ``TREE_ROWS`` rows each, and write them to
    the shared folder; every round reads them from there, so a lost executor costs the
    tasks it ran. Equal parts of vectors are one point of a tree with a count, so copies cost nothing.

    Rows whose vector is null, empty or holds a component that is null, not finite or
    ``2**28`` and more after scaling are left out, as are vectors of another length than that of the
    smallest id whose length ``parts`` divides. Rows that repeat count and return as often as they occur.
    Null ids come last in the order of ids; of rows with one id the smaller vector comes first. Null groups
    are kept. With fewer rows than ``entries`` the codebooks are that much smaller; an empty table
    gives no rows and codebooks without entries. Other columns are not read.
    """
    spark = vectors.sparkSession
    clean = vectors.where(usable(vector, scale)).select(
        F.col(id_column).alias("_id"), F.col(group).alias("_group"), scaled(vector, scale).alias("_v")
    )
    kept, width = one_length(clean, "_id", "_v", parts)
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    if not width:
        rows = kept.select("_id", "_group", F.lit(None).cast("array<int>").alias("code"), F.lit(None).cast("long").alias("error"))
        return rows.withColumnsRenamed({"_id": id_column, "_group": group}), np.zeros((parts, 0, 0), np.int64)
    begin = kept.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()
    first = np.array([r["_v"] for r in begin], np.int64)
    books = np.ascontiguousarray(first.reshape(len(first), parts, width // parts).transpose(1, 0, 2))
    folder = fresh_path(spark, "code-trees")
    kept.mapInArrow(
        _tree_batches(parts, width), f"ids array<{kinds['_id']}>, groups array<{kinds['_group']}>, trees {_TREE}"
    ).write.parquet(folder)
    trees = spark.read.parquet(folder)
    for _ in range(rounds):
        books = next_books(trees, books)
    rows = cut_lineage(
        trees.select("ids", "groups", "trees").mapInArrow(
            _code_batches(books), f"_id {kinds['_id']}, _group {kinds['_group']}, code array<int>, error long"
        ),
        "codes",
    )
    drop_folder(folder)
    return rows.withColumnsRenamed({"_id": id_column, "_group": group}), books


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, joined by commas."""
    return sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


_KEPT_SQL = """kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
    SELECT vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS w FROM kept, range(4) AS t(p)
), book0 AS MATERIALIZED (
    SELECT p, e, w FROM (SELECT p, w, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM parts) WHERE e < 256
)"""

_NEAREST_SQL = """near{n} AS MATERIALIZED (
    SELECT vec_id, label, p, any_value(w) AS w, min(d * 256 + e) AS nearest
    FROM (
        SELECT x.vec_id, x.label, x.p, x.w, b.e, CAST(list_inner_product(x.w, x.w) - 2 * list_inner_product(x.w, b.w)
            + list_inner_product(b.w, b.w) AS BIGINT) AS d
        FROM (SELECT vec_id, label, p, CAST(w AS DOUBLE[]) AS w FROM parts) AS x
        JOIN (SELECT p, e, CAST(w AS DOUBLE[]) AS w FROM book{n}) AS b ON x.p = b.p
    ) GROUP BY vec_id, label, p
)"""

_BOOK_SQL = """book{m} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(u.w, b.w) AS w
    FROM book{n} AS b LEFT JOIN (
        SELECT p, e, list(CAST((s - ((s % c) + c) % c) // c AS BIGINT) ORDER BY i) AS w
        FROM (
            SELECT p, e, i, CAST(sum(CAST(w[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS c
            FROM (SELECT p, nearest % 256 AS e, w, unnest(range(1, len(w) + 1)) AS i FROM near{n}) GROUP BY p, e, i
        ) GROUP BY p, e
    ) AS u ON b.p = u.p AND b.e = u.e
)"""

_ROWS_SQL = """found AS (
    SELECT vec_id, label, string_agg(format('{{:02x}}', nearest % 256), '' ORDER BY p) AS code,
        CAST(sum(nearest // 256) AS BIGINT) AS error
    FROM near4 GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) FROM book4) AS codebooks_sha256
FROM found"""


def _oracle() -> str:
    steps = [_KEPT_SQL]
    for n in range(4):
        steps += [_NEAREST_SQL.format(n=n), _BOOK_SQL.format(n=n, m=n + 1)]
    return "WITH " + ",\n".join([*steps, _NEAREST_SQL.format(n=4), _ROWS_SQL.replace("{{", "{").replace("}}", "}")])


@query("op13_vector_codes", _oracle())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = product_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    totals = rows.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digits = [F.lower(F.lpad(F.hex(F.col("code")[p]), 2, "0")) for p in range(4)]
    return rows.join(totals, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", F.concat(*digits).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
