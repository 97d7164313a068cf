"""Jaccard join on word shingles through MinHash paths of one fixed depth."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.llm.shingles import set_mark, shingle_set
from linewright.operators.graph import connected_components
from linewright.operators.groups import gather, whole_groups
from linewright.session import cut_lineage

TREES = 20
#: Labels on a path of a trie; each is 16 bits of one minimum.
DEPTH = 8
#: Representatives and shingles that a block of a candidate component holds on average.
BLOCK_DOCS = 512
BLOCK_SHINGLES = 400_000
#: Columns of the membership matrix that are multiplied at a time.
MATRIX_COLUMNS = 4096

SIGNED = "doc_id long, text_hash long, mark binary, n_shingles int, forest binary"
FOUND = "rep long, links long, linked_docs long, other long"


def recall_at(depth: int, trees: int, threshold: float) -> float:
    """Chance that a pair at the threshold shares a path of this length in some tree."""
    return 1.0 - (1.0 - threshold**depth) ** trees


def depth_for(recall: float, threshold: float, trees: int = TREES, longest: int = DEPTH) -> int:
    """Start at the leaves and shorten the common path until the target recall is met."""
    depth = longest
    while depth > 1 and recall_at(depth, trees, threshold) < recall:
        depth -= 1
    return depth


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 32, size=(2, n), dtype=np.uint64).astype(np.uint32)


def forest_labels(shingles: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """Labels of one set, a row per tree: 16 mixed bits of each of ``trees * depth`` minima."""
    factors, shifts = _multipliers(trees * depth)
    factors |= np.uint32(1)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(high), 1024):
        block = high[at : at + 1024, None] * factors + shifts
        np.minimum(least, block.min(axis=0), out=least)
    # Minima are small numbers; mixing brings their low bits into the label.
    spread = least * np.uint32(0x85EBCA6B)
    return ((spread ^ (spread >> np.uint32(15))) >> np.uint32(8)).astype(">u2").reshape(trees, depth)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, sizes, forests = [], [], []
        seen: dict[bytes, bytes] = {}
        for text in batch.column(2):
            shingles = shingle_set(text.as_py())
            mark = set_mark(shingles)
            if mark not in seen:
                seen[mark] = forest_labels(shingles).tobytes()
            marks.append(mark)
            sizes.append(len(shingles))
            forests.append(seen[mark])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(marks, pa.binary()), pa.array(sizes, pa.int32()),
             pa.array(forests, pa.binary())],
            names=["doc_id", "text_hash", "mark", "n_shingles", "forest"],
        )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each representative's text; a row whose text is another one is left out."""
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != "text"}
        keep, sets = [], []
        for i, text in enumerate(batch.column("text")):
            shingles = shingle_set(text.as_py())
            if set_mark(shingles) == columns["mark"][i]:
                keep.append(i)
                sets.append(shingles.tobytes())
        rows = pa.table(batch.drop_columns(["text", "mark"])).take(pa.array(keep, pa.int64()))
        yield from rows.append_column("shingles", pa.array(sets, pa.binary())).combine_chunks().to_batches()


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets have in common, by products of membership columns."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # A shingle that one set alone has adds nothing.
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), np.float32)
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + MATRIX_COLUMNS + 1, MATRIX_COLUMNS))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            member = np.zeros((n, MATRIX_COLUMNS), np.float32)
            member[owner[a:b], column[a:b] % MATRIX_COLUMNS] = 1
            common += member @ member.T
    return common


def _spanning(pairs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that keep connected what the pairs connect, at most one per row."""
    root = list(range(len(pairs)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(pairs)):
        for j in np.flatnonzero(pairs[i, :i]):
            a, b = find(i), find(int(j))
            if a != b:
                root[a] = b
                yield i, int(j)


def _verify_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, groups in whole_groups(batches, ["component", "left", "right"]):
            names = ("left", "right", "block", "rep", "copies", "shingles")
            columns = {n: rows.column(n).to_pylist() for n in names}
            reps, links, docs, others = [], [], [], []
            for a, b in groups:
                # A row that is in the table twice is one text.
                at = list({columns["rep"][i]: i for i in range(a, b)}.values())
                sets = [np.frombuffer(columns["shingles"][i], np.uint64) for i in at]
                sizes = np.array([len(s) for s in sets], np.float64)
                common = _overlaps(sets).astype(np.float64)
                similar = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-9
                np.fill_diagonal(similar, False)
                left, right = columns["left"][at[0]], columns["right"][at[0]]
                if left != right:
                    block = np.array([columns["block"][i] for i in at])
                    similar &= block[:, None] != block[None, :]
                copies = np.array([columns["copies"][i] for i in at], np.int64)
                number, weight = similar.sum(axis=1), similar @ copies
                for i in np.flatnonzero(number):
                    reps.append(columns["rep"][at[i]])
                    links.append(int(number[i]))
                    docs.append(int(weight[i]))
                    others.append(None)
                for i, j in _spanning(similar):
                    reps.append(columns["rep"][at[i]])
                    links.append(0)
                    docs.append(0)
                    others.append(columns["rep"][at[j]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (reps, links, docs, others)],
                names=["rep", "links", "linked_docs", "other"],
            )

    return run


def _components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rep, component`` for all ``nodes``; components are named by their smallest member."""
    files = nodes.select(F.lit(0).alias("review_id"), F.col("rep").alias("file_id"))
    return connected_components(files, edges).select(F.col("file_id").alias("rep"), F.col("component_id").alias("component"))


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """``doc_id, text_hash, class_id, n_links, n_texts_linked, n_copies, kept`` for every row.

    Rows with the same set of five-word shingles are copies, and one of them stands for all.
    Each representative has a path in each of ``TREES`` tries of MinHash labels. Two of them
    are candidates if they share a path of some length; the length is shortened from the
    leaves up until a pair at the ``threshold`` is found with probability ``recall``. All pairs
    of what candidates connect are then checked on the whole sets, with a common path or
    without, and links have Jaccard similarity of at least ``threshold``. A class is what links connect, named by its smallest ``doc_id``.

    Pairs are never rows. Candidates that hang together form a component, whose sets are sent
    there once; large components are cut into blocks, and each two blocks
    meet in a task that counts links by matrix products and returns a count per text and a
    spanning forest. Hot trie nodes only meet one row per node in a join.

    ``n_links`` counts linked rows, copies included; ``n_texts_linked`` counts different sets.
    ``kept`` marks one row per class: smallest ``doc_id``, nulls last, and among rows that
    agree in it the one with the smallest text hash; rows that are equal in both are all marked.

    Needs ``doc_id, text``; other columns are not read. A text with fewer than five words is
    one shingle. Texts without words and null texts are alone, each kept. Texts of any length
    are compared whole. An empty table gives no rows.
    """
    depth = depth_for(recall, threshold)
    signed = cut_lineage(
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
        .mapInArrow(_sign_batches, SIGNED),
        "near-signed",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    reps = cut_lineage(
        signed.where("n_shingles > 0")
        .groupBy("mark", "n_shingles", "forest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(order).alias("first"))
        .withColumn("rep", F.monotonically_increasing_id()),
        "near-reps",
    )
    step = 2 * DEPTH
    paths = reps.select(
        "rep",
        F.posexplode(
            F.array(*[F.substring("forest", t * step + 1, 2 * depth) for t in range(TREES)])
        ).alias("tree", "path"),
    )
    nodes = paths.groupBy("tree", "path").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = cut_lineage(
        paths.join(nodes, ["tree", "path"]).where("rep <> low").select(F.col("rep").alias("src"), F.col("low").alias("dst")).distinct(),
        "near-edges",
    )
    touched = near.select(F.explode(F.array("src", "dst")).alias("rep")).distinct()
    parts = cut_lineage(_components(touched, near), "near-parts")
    sizes = (
        parts.join(reps.select("rep", "n_shingles"), "rep")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
        .select(
            "component",
            F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"),
        )
    )
    wanted = (
        parts.join(sizes, "component")
        .join(reps, "rep")
        .select(
            "rep", "component", "copies", "mark", "blocks",
            F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"),
            F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"),
        )
    )
    texts = docs.select("doc_id", "text").withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    sets = (
        texts.join(wanted, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .select("rep", "component", "copies", "mark", "blocks", "block", "text")
        .mapInArrow(
            _set_batches,
            "rep long, component long, copies long, blocks int, block int, shingles binary",
        )
    )
    # A text meets its own block and every other block of its component.
    meetings = sets.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"),
        "block", "rep", "copies", "shingles",
    )
    found = cut_lineage(
        gather(meetings, ["component", "left", "right"], "rep", spread=False).mapInArrow(
            _verify_batches(threshold), FOUND
        ),
        "near-found",
    )
    links = found.where("other is null").groupBy("rep").agg(
        F.sum("links").alias("_texts"), F.sum("linked_docs").alias("_docs")
    )
    joined = found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    linked = cut_lineage(_components(links.select("rep"), joined), "near-classes")
    classed = reps.select("rep", "mark", "copies", "first").join(linked, "rep", "left").join(links, "rep", "left")
    classed = classed.withColumn("component", F.coalesce("component", "rep"))
    firsts = classed.groupBy("component").agg(F.min("first").alias("_keeper"))
    labels = classed.join(firsts, "component").select(
        "mark", "copies", F.coalesce("_texts", F.lit(0)).alias("_texts"), F.coalesce("_docs", F.lit(0)).alias("_docs"), "_keeper"
    )
    return signed.select("doc_id", "text_hash", "mark", "n_shingles").join(
        labels, (signed["mark"] == labels["mark"]) & (F.col("n_shingles") > 0), "left"
    ).select(
        "doc_id", "text_hash",
        F.when(F.col("_keeper").isNull(), F.col("doc_id")).otherwise(F.col("_keeper.doc_id")).alias("class_id"),
        (F.coalesce("_docs", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        F.coalesce("_texts", F.lit(0)).cast("long").alias("n_texts_linked"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"),
        F.when(F.col("_keeper").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("_keeper.doc_id")) & (F.col("text_hash") == F.col("_keeper.text_hash")))
        .alias("kept"),
    )


@query("op5_near_duplicates")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")
