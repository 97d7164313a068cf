"""Hard negatives by exact inner-product search along lists that clusters of anchors share.

Anchors are clustered by direction. For a cluster with centre ``c`` and widest member angle ``w``, a row at
angle ``t`` from ``c`` is at least ``t - w`` away from every member, so ``|row| * cos(max(0, t - w))``
times the member's own length bounds its score. The rows, sorted once per cluster by that bound, are
the list of all its members. A member walks it block by block until no later row can change its
result, which the bound of the next block proves.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.llm.vectors import one_length, products, scaled, usable
from linewright.session import drop_folder, fresh_path

CLUSTERS = 8
#: Anchors that the centres are fitted on; every anchor is then assigned.
FIT_ANCHORS = 4096
FIT_ROUNDS = 8
#: Entries of a list, and members, that are multiplied at once.
LIST_BLOCK = 1024
MEMBER_BLOCK = 256
#: Each round of the walk reaches this many times as far down the lists.
REACH = 8
#: List blocks that meet under one key.
SLICE_BLOCKS = 8
#: Angles are computed in doubles; radii are wider and caps higher by this.
SLACK = 1e-6

_LISTED = "cluster int, bound double, id long, label long, v array<int>"
_BLOCKS = "cluster int, first_bound double, block string, ids binary, labels binary, vectors binary"
_FOUND = "a long, positive int, score long, id long"


def _lengths(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", m.astype(np.float64), m.astype(np.float64)))


def _directions(m: np.ndarray) -> np.ndarray:
    length = _lengths(m)
    return m / np.where(length > 0, length, 1)[:, None]


def _angles(m: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angles of rows to centres; a zero row has every angle, so it gets the right angle of its product."""
    return np.arccos(np.clip(_directions(m) @ centers.T, -1, 1))


def fit_centers(sample: np.ndarray, clusters: int) -> np.ndarray:
    """Unit centres by spherical k-means; the first are rows that are far from each other."""
    units = _directions(sample)
    chosen = [0]
    nearest = units @ units[0]
    while len(chosen) < min(clusters, len(units)):
        far = int(nearest.argmin())
        if nearest[far] >= 1 - 1e-12:
            break
        chosen.append(far)
        nearest = np.maximum(nearest, units @ units[far])
    centers = units[chosen]
    for _ in range(FIT_ROUNDS):
        own = (units @ centers.T).argmax(axis=1)
        for k in range(len(centers)):
            mean = units[own == k].sum(axis=0)
            if np.linalg.norm(mean) > 1e-9:
                centers[k] = mean / np.linalg.norm(mean)
    return centers


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def _member_batches(centers: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("v"), centers.shape[1])
            angles = _angles(v, centers)
            own = angles.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own, pa.int32()), pa.array(angles[np.arange(len(own)), own]), pa.array(_lengths(v))],
                names=[*batch.schema.names, "cluster", "angle", "length"],
            )

    return run


def _list_batches(centers: np.ndarray, widest: dict[int, float]):
    """Every row once for each cluster, with its bound there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch.column("v"), centers.shape[1])
            angles, lengths = _angles(v, centers), _lengths(v)
            for cluster, wide in widest.items():
                bound = lengths * np.cos(np.maximum(0, angles[:, cluster] - wide - SLACK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(v), cluster, np.int32)), pa.array(bound), *(batch.column(c) for c in ("id", "label", "v"))],
                    names=["cluster", "bound", "id", "label", "v"],
                )

    return run


def _block_batches(width: int):
    """Consecutive entries of one list as one row; within it they stand by id, for ties."""

    def block(part: int, number: int, rows: pa.Table) -> dict:
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = np.asarray(rows.column("v").combine_chunks().flatten(), dtype=np.int32).reshape(-1, width)
        return {
            "cluster": rows.column("cluster")[0].as_py(), "first_bound": rows.column("bound")[0].as_py(), "block": f"{part}-{number}",
            "ids": ids[order].tobytes(), "labels": rows.column("label").to_numpy()[order].tobytes(), "vectors": v[order].tobytes(),
        }

    schema = pa.schema([("cluster", pa.int32()), ("first_bound", pa.float64()), ("block", pa.string()), ("ids", pa.binary()),
                        ("labels", pa.binary()), ("vectors", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []
        cluster, held = None, 0
        for batch in batches:
            clusters = batch.column("cluster").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(clusters)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                while a < b:
                    if held and (clusters[a] != cluster or held == LIST_BLOCK):
                        yield pa.RecordBatch.from_pylist([block(part, number, pa.Table.from_batches(waiting))], schema=schema)
                        waiting, held, number = [], 0, number + 1
                    cluster = clusters[a]
                    some = min(b - a, LIST_BLOCK - held)
                    waiting.append(batch.slice(a, some))
                    held, a = held + some, a + some
        if held:
            yield pa.RecordBatch.from_pylist([block(part, number, pa.Table.from_batches(waiting))], schema=schema)

    return run


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``k`` highest allowed scores of each row, ties to the lower column."""
    n = scores.shape[1]
    if np.abs(scores).max(initial=0) < 1 << 50:
        lowest = np.iinfo(np.int64).min
        keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), lowest)
        top = np.argpartition(keys, n - k, axis=1)[:, n - k :] if n > k else np.tile(np.arange(n), (len(keys), 1))
        row, place = np.nonzero(np.take_along_axis(keys, top, axis=1) != lowest)
        return row, top[row, place]
    rows, columns = [], []
    for i in range(len(scores)):
        open_columns = np.flatnonzero(allowed[i])
        top = open_columns[np.argsort(-scores[i, open_columns], kind="stable")[:k]]
        rows += [i] * len(top)
        columns += top.tolist()
    return np.array(rows, np.int64), np.array(columns, np.int64)


def _score_batches(width: int, k: int, same: bool, n_ranges: int):
    """The best ``k`` entries of a list block for each range of each member of a member block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members = batch.column("members")[i].values
                a = np.asarray(members.field("v").flatten()).reshape(-1, width)
                ids, labels = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "labels"))
                b = np.frombuffer(batch.column("vectors")[i].as_py(), np.int32).reshape(-1, width)
                scores = products(a, b)
                alike = members.field("label").to_numpy()[:, None] == labels[None]
                fit = (alike if same else ~alike) & (members.field("id").to_numpy()[:, None] != ids[None])
                low, high = (np.asarray(members.field(c).flatten()).reshape(-1, n_ranges) for c in ("low", "high"))
                names = members.field("a").to_numpy()
                for j in range(n_ranges):
                    row, column = _best(scores, fit & (scores >= low[:, j, None]) & (scores <= high[:, j, None]), k)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[row]), pa.array(np.full(len(row), j, np.int32)), pa.array(scores[row, column]), pa.array(ids[column])],
                            names=["a", "positive", "score", "id"],
                        )

    return run


class SharedLists:
    """The lists of all clusters in the shared folder, with the bound that each round ends above."""

    def __init__(self, rows: DataFrame, width: int, centers: np.ndarray, widest: dict[int, float]):
        spark = rows.sparkSession
        self.width = width
        self._folder = fresh_path(spark, "shared-lists")
        listed = rows.mapInArrow(_list_batches(centers, widest), _LISTED)
        # The id splits entries of one bound, however many rows repeat one vector.
        (
            listed.repartitionByRange("cluster", F.desc("bound"), "id")
            .sortWithinPartitions("cluster", F.desc("bound"), "id")
            .mapInArrow(_block_batches(width), _BLOCKS)
            .write.parquet(self._folder)
        )
        self.blocks = spark.read.parquet(self._folder)
        sizes = {r["cluster"]: r["n"] for r in self.blocks.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.rounds = 1 + max(0, math.ceil(math.log(max(sizes.values(), default=1), REACH)))
        shares = [1 - float(REACH) ** (r + 1 - self.rounds) for r in range(self.rounds - 1)]
        marks = {}
        if shares:
            for r in self.blocks.groupBy("cluster").agg(F.percentile_approx("first_bound", shares, 10_000).alias("at")).collect():
                marks[r["cluster"]] = r["at"]
        #: (cluster, round) -> bounds of its first entries, from the first number on and below the second.
        self._spans: dict[tuple[int, int], tuple[float, float]] = {}
        number = F.lit(self.rounds - 1)
        for cluster in sizes:
            edges = [math.inf, *marks.get(cluster, []), -math.inf]
            for r in reversed(range(self.rounds)):
                self._spans[cluster, r] = (edges[r + 1], edges[r])
                number = F.when(self._in_span(cluster, r), r).otherwise(number)
        numbered = self.blocks.select("cluster", "first_bound", number.alias("round"))
        found = numbered.groupBy("cluster", "round").agg(F.max("first_bound").alias("top"), F.count(F.lit(1)).alias("n")).collect()
        self.slices = {(r["cluster"], r["round"]): max(1, r["n"] // SLICE_BLOCKS) for r in found}
        self.after = {
            (c, r): max([x["top"] for x in found if x["cluster"] == c and x["round"] > r], default=None)
            for c in widest for r in range(self.rounds)
        }

    def _in_span(self, cluster: int, round_: int) -> Column:
        """Plain comparisons, which the scan tests on the statistics of the sorted files."""
        low, high = self._spans[cluster, round_]
        out = F.col("cluster") == cluster
        if low > -math.inf:
            out &= F.col("first_bound") >= low
        if high < math.inf:
            out &= F.col("first_bound") < high
        return out

    def _by_cluster(self, values: dict[int, object], kind: str) -> Column:
        out = F.lit(None)
        for cluster, value in values.items():
            out = F.when(F.col("cluster") == cluster, F.lit(value)).otherwise(out)
        return out.cast(kind)

    def cap(self, round_: int) -> Column:
        """What no score of a member beyond the round exceeds; null where its list ends."""
        bound = self._by_cluster({c: self.after[c, round_] for c, r in self.after if r == round_}, "double") * F.col("length")
        return bound + F.abs(bound) * F.lit(SLACK) + F.lit(SLACK)

    def meet(self, members: DataFrame, round_: int, k: int, same: bool, n_ranges: int) -> DataFrame:
        """``a, positive, score, id``: of each list block of the round, the best ``k`` per range.

        Members meet the list in blocks: each member block goes to every slice of its cluster's
        part of the list, so no key holds more than ``2 * SLICE_BLOCKS`` list blocks or so.
        """
        slices = self._by_cluster({c: n for (c, r), n in self.slices.items() if r == round_}, "int")
        wanted = F.lit(False)
        for cluster, r in self.slices:
            if r == round_:
                wanted |= self._in_span(cluster, r)
        part = self.blocks.where(wanted).withColumn("slice", F.pmod(F.xxhash64("block"), slices).cast("int"))
        group = F.collect_list(F.struct("a", "id", "label", "v", "low", "high")).alias("members")
        blocked = members.groupBy("cluster", "member_block").agg(group).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
        pairs = part.join(blocked, ["cluster", "slice"]).select("members", "ids", "labels", "vectors")
        return pairs.mapInArrow(_score_batches(self.width, k, same, n_ranges), _FOUND)

    def drop(self) -> None:
        drop_folder(self._folder)


def _top(found: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("a", "positive").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


class _Folders:
    """Steps in the shared folder; one is deleted when a later one has replaced it."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        if name in self._paths:
            drop_folder(self._paths[name])
        self._paths[name] = path
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self._paths:
                drop_folder(self._paths.pop(name))


def _walk(lists: SharedLists, members: DataFrame, k: int, same: bool, n_ranges: int, folders: _Folders, name: str) -> DataFrame:
    """The best ``k`` rows of each range ``low`` to ``high`` of each member: ``a, positive, score, id, rank``.

    After each round, ranges are settled that have ``k`` rows all better than the cap of what is left, or
    whose lower end lies above it; members with an open range go on, and take no row any
    more that could not come among the ``k``.
    """
    spark = members.sparkSession
    found = spark.createDataFrame([], f"{_FOUND}, rank int")
    going = members
    for round_ in range(lists.rounds):
        new = lists.meet(going, round_, k, same, n_ranges)
        found = folders.write(_top(found.drop("rank").unionByName(new), k), name)
        if round_ == lists.rounds - 1:
            break
        last = found.where(F.col("rank") == k).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("positive", "score"))).alias("kth"))
        kth = lambda j: F.element_at("kth", j.cast("int"))
        status = (
            going.join(last, "a", "left")
            .withColumn("cap", lists.cap(round_))
            # A row beyond the k-th cannot displace it with an equal score unless its id is smaller.
            .withColumn("low", F.transform("low", lambda x, j: F.greatest(x, F.coalesce(kth(j), x))))
            .withColumn(
                "low",
                F.transform(
                    "low",
                    lambda x, j: F.when((x > F.col("cap")), F.lit(2**63 - 1)).otherwise(x),
                ),
            )
            .where(F.col("cap").isNotNull() & F.exists("low", lambda x: x < F.lit(2**63 - 1)))
        )
        going = folders.write(status.drop("kth", "cap"), f"{name}-open")
        if not going.head(1):
            break
    folders.drop(f"{name}-open")
    return found


def hard_negatives(
    vectors: DataFrame, anchor: Column, id_column: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, clusters: int = CLUSTERS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Components become ``floor(scale * x)``, scores are inner products, higher ones come first and ties go
    to the smaller id. The positives of an anchor are its best ``positives`` rows of its own label. For each of
    them, the negatives are the best ``negatives`` rows of other labels whose score lies between
    ``low`` and ``high`` per cent of the positive's. All rows are searched; nothing is approximate.

    Anchors are clustered on at most ``FIT_ANCHORS`` of them, by hash; the clusters decide the work and never the
    result. The lists take ``clusters`` times the room of the vectors. They are written once and read
    by both walks, first for the positives, then for the negatives in the ranges these give.

    ``anchor`` is a condition on the input's columns. Rows with a null id or label, and rows whose vector is null,
    empty or holds a component that is null, not finite or ``2**28`` and more after scaling
    take no part, nor do vectors of another length than that of the smallest id. Rows with the
    anchor's id are not its candidates. An anchor that repeats wholly counts once; other rows count as
    often as they occur. Positives with a negative score have no negatives, nor has an anchor
    without a row of its label. Ids and labels are whole numbers. Other columns are not read; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    clean = (
        vectors.where(usable(vector, scale) & F.col(id_column).isNotNull() & F.col(label).isNotNull())
        .select(
            F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), scaled(vector, scale).alias("v"),
            F.coalesce(anchor, F.lit(False)).alias("anchor"),
        )
    )
    rows, width = one_length(clean, "id", "v")
    empty = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    chosen = rows.where("anchor").select("id", "label", "v").distinct()
    sample = chosen.orderBy(F.xxhash64("id", "label", "v")).limit(FIT_ANCHORS).select("v").collect() if width else []
    if not sample:
        return empty
    centers = fit_centers(np.array([r["v"] for r in sample], np.float64), clusters)
    folders = _Folders(spark)
    members = folders.write(
        chosen.select(F.monotonically_increasing_id().alias("a"), "id", "label", "v").mapInArrow(
            _member_batches(centers), "a long, id long, label long, v array<int>, cluster int, angle double, length double"
        ),
        "anchors",
    )
    sizes = members.groupBy("cluster").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).collect()
    n_blocks = F.lit(1)
    for r in sizes:
        n_blocks = F.when(F.col("cluster") == r["cluster"], -(-r["n"] // MEMBER_BLOCK)).otherwise(n_blocks)
    members = members.withColumn("member_block", F.pmod(F.xxhash64("a"), n_blocks).cast("int")).drop("angle")
    lists = SharedLists(rows.select("id", "label", "v"), width, centers, {r["cluster"]: r["widest"] for r in sizes})

    whole = [F.array(F.lit(x).cast("long")) for x in (-(2**63) + 1, 2**63 - 2)]
    best = _walk(lists, members.withColumns({"low": whole[0], "high": whole[1]}), positives, True, 1, folders, "positives")
    # Without products that leave 64 bits: x = 100 q + r.
    score = F.col("score")
    q, r = F.expr("score div 100"), F.pmod(score, F.lit(100))
    ranges = best.where(score >= 0).select(
        "a", "rank",
        (q * low + F.ceil(r * low / 100.0)).cast("long").alias("least"), (q * high + F.floor(r * high / 100.0)).cast("long").alias("most"),
    )
    gathered = ranges.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("rank", F.struct("least", "most").alias("x")))).alias("by"))
    slots = F.sequence(F.lit(1), F.lit(positives))
    # A place without a positive gets a range that nothing falls into.
    of = lambda side, none: F.transform(slots, lambda j: F.coalesce(F.element_at("by", j)[side], F.lit(none).cast("long")))
    seeking = members.join(gathered, "a").withColumn("low", of("least", 2**63 - 1)).withColumn("high", of("most", -(2**63) + 1)).drop("by")
    mined = _walk(lists, seeking, negatives, False, positives, folders, "negatives")
    result = (
        mined.withColumn("_rank", F.col("positive") + 1)
        .select("a", "_rank", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(best.select("a", F.col("rank").alias("_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), ["a", "_rank"])
        .join(members.select("a", F.col("id").alias("anchor_id")), "a")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
    lists.drop()
    return result


ORACLE = """WITH kept AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
    FROM kept AS a JOIN kept AS c ON a.vec_id <> c.vec_id
    WHERE a.vec_id % 100 = 0
), best AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM best JOIN scores USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10"""


@query("op11_hard_negatives", ORACLE)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")).alias("label"),
    )
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
