"""Token-bounded batches of linked files."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators.groups import gather
from linewright.operators.spread import running_rank, running_sum_before
from linewright.session import cut_lineage

COMPONENT = ["review_id", "component_id"]
_RUN_ROWS = 100_000
_FILLS = (
    "review_id long, component_id long, kind string, file_id long, chunk_ord long, tokens long, "
    "first_rank long, files long, per_bin long, first_bin long"
)


def component_tokens(files: DataFrame) -> DataFrame:
    """Token sum and file count per component; ``files`` has ``tokens``."""
    return files.groupBy(*COMPONENT).agg(
        F.sum(F.col("tokens").cast("long")).alias("component_tokens"),
        F.count(F.lit(1)).alias("file_count"),
    )


def split_by_budget(files: DataFrame, budget: int = fv.TOKEN_BUDGET) -> tuple[DataFrame, DataFrame]:
    """Files of components that fit one batch, and files of those that do not."""
    sums = component_tokens(files).select(*COMPONENT, "component_tokens")
    known = files.join(sums, COMPONENT)
    fits = F.col("component_tokens") <= budget
    return known.where(fits), known.where(~fits)


def chunk_starts(lines, budget: int):
    """First line numbers of the chunks of a file, folded over its lines.

    A chunk closes before the line that would overfill it; one overlong line stays whole.
    """
    room = budget * fv.CHARS_PER_TOKEN
    zero = F.lit(0).cast("long")
    start = F.struct(
        F.array(F.lit(1).cast("long")).alias("starts"), zero.alias("chars"), zero.alias("held"), zero.alias("seen")
    )

    def step(state, line):
        size = text.utf16_length(line).cast("long")
        closes = (state["chars"] + size > room) & (state["held"] > 0)
        number = state["seen"] + 1
        return F.struct(
            F.when(closes, F.concat(state["starts"], F.array(number))).otherwise(state["starts"]).alias("starts"),
            (F.when(closes, 0).otherwise(state["chars"]) + size + 1).cast("long").alias("chars"),
            (F.when(closes, 0).otherwise(state["held"]) + 1).cast("long").alias("held"),
            number.alias("seen"),
        )

    return F.aggregate(lines, start, step, lambda state: state["starts"])


def chunk_large_files(files: DataFrame, budget: int = fv.TOKEN_BUDGET) -> DataFrame:
    """Chunks of the files above the budget; narrow, a file is cut where it is read."""
    keep = [c for c in files.columns if c != "content"]
    large = files.where(F.col("tokens") > budget).withColumn(
        "lines", text.split_lines(F.col("content"))
    )
    cut = large.select(*keep, "lines", chunk_starts(F.col("lines"), budget).alias("starts"))
    placed = cut.select(*keep, "lines", "starts", F.posexplode("starts").alias("chunk_ord", "first_line"))
    after = F.coalesce(
        F.try_element_at("starts", F.col("chunk_ord") + 2), F.size("lines").cast("long") + 1
    )
    chunk = F.array_join(
        F.slice("lines", F.col("first_line").cast("int"), (after - F.col("first_line")).cast("int")), "\n"
    )
    return placed.select(
        *keep,
        F.col("chunk_ord").cast("long").alias("chunk_ord"),
        "first_line",
        (after - 1).alias("last_line"),
        chunk.alias("content"),
    ).withColumn("chunk_tokens", text.token_estimate(F.col("content")).cast("long"))


class _Sizes:
    """Files still to place, as counts per size."""

    def __init__(self):
        self.sizes: list[int] = []  # ascending
        self.left: dict[int, int] = {}
        self.used: dict[int, int] = {}

    def add(self, size: int, count: int) -> None:
        self.sizes.append(size)
        self.left[size] = count
        self.used[size] = 0

    def plan(self, room: int) -> list[tuple[int, int]]:
        """What one bin with this much room takes, largest size first."""
        taken = []
        at = bisect_right(self.sizes, room)
        while at > 0:
            size = self.sizes[at - 1]
            count = self.left[size] if size == 0 else min(self.left[size], room // size)
            taken.append((size, count))
            room -= size * count
            at = min(at - 1, bisect_right(self.sizes, room))
        return taken

    def take(self, size: int, count: int) -> int:
        """Take files of a size; returns the rank of the first of them."""
        first = self.used[size]
        self.used[size] += count
        self.left[size] -= count
        if not self.left[size]:
            self.sizes.pop(bisect_right(self.sizes, size) - 1)
        return first


def _packer(budget: int):
    """Packs components that come one after another: first their sizes, then their chunks.

    Placing each file, largest first, into the first bin with room gives the same bins as
    filling bin after bin with the largest files that fit. Filled that way, a bin needs
    only the counts per size, so chunks stream by, and fresh bins repeat one pattern until
    some size runs out; such a run is one row.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, sizes, bins = None, _Sizes(), 0

        def fill(size, count, per_bin, first_bin):
            first = sizes.take(size, count)
            step = max(_RUN_ROWS // per_bin, 1) * per_bin if per_bin < _RUN_ROWS else _RUN_ROWS
            for done in range(0, count, step):
                part = min(step, count - done)
                out.append((*key, "fill", None, None, size, first + done, part, per_bin, first_bin + done // per_bin))

        def finish():
            nonlocal bins
            while sizes.sizes:
                pattern = sizes.plan(budget)
                repeats = min(sizes.left[size] // count for size, count in pattern)
                for size, count in pattern:
                    fill(size, count * repeats, count, bins)
                bins += repeats

        def flush():
            nonlocal out
            rows, out = out, []
            columns = list(zip(*rows)) if rows else [[] for _ in _PACK_SCHEMA]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PACK_SCHEMA)], schema=_PACK_SCHEMA
            )

        for batch in batches:
            for row in batch.to_pylist():
                if key != (row["review_id"], row["component_id"]):
                    if key is not None:
                        finish()
                    key, sizes, bins = (row["review_id"], row["component_id"]), _Sizes(), 0
                if row["is_chunk"]:
                    out.append((*key, "chunk", row["file_id"], row["chunk_ord"], row["tokens"], None, 1, None, bins))
                    for size, count in sizes.plan(budget - row["tokens"]):
                        fill(size, count, count, bins)
                    bins += 1
                else:
                    sizes.add(row["tokens"], row["files"])
            if out:
                yield flush()
        if key is not None:
            finish()
        if out:
            yield flush()

    return pack


_PACK_SCHEMA = pa.schema(
    [("review_id", pa.int64()), ("component_id", pa.int64()), ("kind", pa.string())]
    + [(name, pa.int64()) for name in (
        "file_id", "chunk_ord", "tokens", "first_rank", "files", "per_bin", "first_bin")]
)


def pack_components(files: DataFrame, chunks: DataFrame, budget: int = fv.TOKEN_BUDGET) -> DataFrame:
    """First-fit-decreasing batches of components that are over the budget.

    ``files`` are all files of those components, ``chunks`` the chunks of their files above
    the budget. A component goes into its fold as one row per distinct size, at most the
    budget, plus its chunks in order, which stream through. Files then find their batch by
    their rank among files of equal size, an equality join on a key no two files share.
    """
    small = files.where(F.col("tokens") <= budget)
    sizes = small.groupBy(*COMPONENT, F.col("tokens").cast("long").alias("tokens")).agg(
        F.count(F.lit(1)).alias("files")
    )
    none = F.lit(None).cast("long")
    todo = sizes.select(
        *COMPONENT, F.lit(False).alias("is_chunk"), F.col("tokens").alias("turn"), none.alias("file_ord"),
        none.alias("file_id"), none.alias("chunk_ord"), "tokens", "files",
    ).unionByName(
        chunks.select(
            *COMPONENT, F.lit(True).alias("is_chunk"), (-F.col("tokens")).cast("long").alias("turn"), "file_ord",
            "file_id", "chunk_ord", F.col("chunk_tokens").alias("tokens"), F.lit(1).cast("long").alias("files"),
        )
    )
    packed = (
        gather(todo, COMPONENT, "is_chunk", "turn", "file_ord", "chunk_ord")
        .mapInArrow(_packer(budget), _FILLS)
    )
    ranks = packed.where("kind = 'fill'").select(
        *COMPONENT, "tokens", "per_bin", "first_bin",
        F.posexplode(F.sequence(F.col("first_rank"), F.col("first_rank") + F.col("files") - 1)).alias("at", "rank"),
    ).select(
        *COMPONENT, "tokens", "rank",
        (F.col("first_bin") + F.floor(F.col("at") / F.col("per_bin"))).cast("long").alias("batch_ord"),
    )
    ranked = running_rank(
        small.select(*COMPONENT, "file_id", "file_ord", F.col("tokens").cast("long").alias("tokens")),
        [*COMPONENT, "tokens"], "file_ord", "rank",
    ).withColumn("rank", F.col("rank") - 1)
    placed = ranked.join(ranks, [*COMPONENT, "tokens", "rank"]).select(
        *COMPONENT, "batch_ord", "file_ord", "file_id", none.alias("chunk_ord"), "tokens"
    )
    cut = packed.where("kind = 'chunk'").join(
        chunks.select("file_id", "chunk_ord", "file_ord"), ["file_id", "chunk_ord"]
    ).select(*COMPONENT, F.col("first_bin").alias("batch_ord"), "file_ord", "file_id", "chunk_ord", "tokens")
    return placed.unionByName(cut)


def create_batches(files: DataFrame, budget: int = fv.TOKEN_BUDGET, chunks: DataFrame | None = None) -> DataFrame:
    """Rows ``(review_id, component_id, batch_ord, file_ord, file_id, chunk_ord, tokens)``.

    ``files`` has review_id, component_id, file_id, file_ord, tokens and content. Small
    components are one batch each and are never put together. Everything but the chunks is
    decided on the narrow columns, which are written out once, as several steps need them.
    A caller that has the ``file_chunks`` hands them in; contents are then not read.
    """
    narrow = cut_lineage(files.drop("content"), "sized")
    whole, over = split_by_budget(narrow, budget)
    none = F.lit(None).cast("long")
    kept = whole.select(
        *COMPONENT, F.lit(0).cast("long").alias("batch_ord"), "file_ord", "file_id",
        none.alias("chunk_ord"), F.col("tokens").cast("long").alias("tokens"),
    )
    if chunks is None:
        chunks = file_chunks(narrow, files, budget)
    return kept.unionByName(pack_components(over, chunks.drop("content"), budget))


def file_chunks(sized: DataFrame, files: DataFrame, budget: int = fv.TOKEN_BUDGET) -> DataFrame:
    """Chunks of the files above the budget; only their contents are read again."""
    large = sized.where(F.col("tokens") > budget)
    return chunk_large_files(large.join(files.select("file_id", "content"), "file_id"), budget)


def batch_stats(batches: DataFrame) -> DataFrame:
    """Index within the review, file count and token estimate of each batch."""
    stats = batches.groupBy(*COMPONENT, "batch_ord").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("tokens").alias("tokens")
    )
    counts = stats.groupBy(*COMPONENT).agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_sum_before(counts, ["review_id"], "component_id", "_n", "_base").drop("_n")
    return (
        stats.join(offsets, COMPONENT)
        .withColumn("batch_index", F.col("_base") + F.col("batch_ord"))
        .drop("_base")
    )
