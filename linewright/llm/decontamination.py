"""Benchmark passages in documents by SimHash windows and a multi-index Hamming join (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linewright.llm.registry import query, table
from linewright.session import cut_lineage

SHINGLE = 5
#: Fingerprints within this distance are candidates; at the default threshold of 0.8 the
#: expected distance is below 10 of 64 bits, with a deviation of about 3.
RADIUS = 19
BLOCKS = 4
BLOCK_BITS = 16
#: Item shingles up to this many rows of one number are broadcast (8 MB); more are joined by shuffle.
BROADCAST_SHINGLES = 1_000_000


def _words(text: Column) -> Column:
    """Runs of letters, digits and ``_`` in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}_]+"), "")


def _shingles(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``keys, at, h``: every run of ``n`` words of ``words`` and its place.

    The word list and its shifted copies are zipped, so rows come out of one generator and
    hashes are compiled code; no lambda runs per word.
    """
    shifted = [F.col("words")] + [
        F.slice("words", i + 1, F.greatest(F.size("words") - i, F.lit(0))) for i in range(1, n)
    ]
    zipped = F.arrays_zip(*[c.alias(f"w{i}") for i, c in enumerate(shifted)])
    rows = df.where(F.size("words") >= n).select(*keys, F.posexplode(zipped).alias("at", "s"))
    names = [f"s.{name}" for name in rows.schema["s"].dataType.names]
    return rows.where(F.col(names[-1]).isNotNull()).select(*keys, "at", F.xxhash64(*names).alias("h"))


def _fingerprint(df: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the shingles of each key: bit i is set if more of them have it than not.

    A shingle counts as often as it occurs, which is its weight. A key is one window or item,
    so its list is no longer than an item.
    """
    gathered = df.groupBy(*keys).agg(F.collect_list("h").alias("_hs")).withColumn("size", F.size("_hs").cast("long"))

    def bit(i: Column) -> Column:
        having = F.filter("_hs", lambda h: F.call_function("shiftright", h, i).bitwiseAND(F.lit(1).cast("long")) == 1)
        return F.when(F.size(having) * 2 > F.col("size"), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))

    mark = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda done, i: done.bitwiseOR(F.call_function("shiftleft", bit(i), i)),
    )
    return gathered.select(*keys, "size", mark.alias("print"))


def _block(i: int) -> Column:
    return F.shiftrightunsigned("print", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int")


def _near_values(radius: int) -> Column:
    """All differences of a block that change at most ``radius`` bits."""
    every = F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) - 1))
    return F.filter(every, lambda d: F.bit_count(d) <= radius)


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``t1, t2, item_id, at, similarity``: windows of documents that repeat an item.

    ``t1, t2`` stand for a text (see ``text_keys``), so equal texts are searched once. A window
    has as many words as the item (fewer at the end of a text) and starts at word ``at``.

    1. A window that reaches the threshold has at least ``threshold`` of as many shingles as
       the item among the shingles of items of its size. Windows with fewer are not looked at;
       this loses none. A window may start at such a shingle, since moving its start up to
       its first one keeps all of them.
    2. Windows and items get a SimHash fingerprint. It is cut into ``BLOCKS`` blocks; two
       fingerprints within ``radius`` differ by at most ``radius // BLOCKS`` bits in some block.
       Items enter the index under every such value of each block and windows look up their
       four values, so every pair within the radius meets.
    3. Pairs within the radius are compared on all their shingles: the sum of the smaller
       over the sum of the larger number of occurrences.
    """
    spark = docs.sparkSession
    keyed = items.select("item_id", _words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    # Written once, so the numbers stay.
    keyed = cut_lineage(
        keyed.select(
            F.monotonically_increasing_id().alias("item"), "item_id", "words", F.size("words").alias("n"),
            F.least(F.size("words"), F.lit(SHINGLE)).alias("k"),
        ),
        "items",
    )
    lengths = sorted(r["k"] for r in keyed.select("k").distinct().collect())
    if not lengths:
        return spark.createDataFrame([], "t1 long, t2 long, item_id long, at int, similarity double")
    parts = [_shingles(keyed.where(F.col("k") == k), ["item", "n", "k"], k) for k in lengths]
    item_rows = parts[0]
    for part in parts[1:]:
        item_rows = item_rows.unionByName(part)
    item_rows = cut_lineage(item_rows, "item-shingles")
    known = cut_lineage(item_rows.select("h").distinct(), "item-known")
    few = known.count() <= BROADCAST_SHINGLES
    texts = docs.select(*[c.alias(n) for n, c in text_keys().items()], _words(F.col("text")).alias("words"))
    hits = None
    for k in lengths:
        rows = _shingles(texts, ["t1", "t2"], k).join(F.broadcast(known) if few else known, "h")
        hits = rows if hits is None else hits.unionByName(rows)
    hits = cut_lineage(hits, "item-hits").distinct()
    classes = item_rows.select("h", "n", "k").distinct()
    hit_rows = hits.join(classes, "h")
    # Shingles of a window of n words: n - k + 1, counted from each hit onwards.
    wide = F.col("n") - F.col("k")
    ahead = _ahead(hit_rows, wide)
    windows = cut_lineage(
        ahead.where(F.col("_hits") >= F.ceil((wide + 1) * threshold - 1e-9)).select("t1", "t2", "n", "k", "at"),
        "item-windows",
    )
    marked = (
        texts.join(windows.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi")
        .dropDuplicates(["t1", "t2"])
        .join(windows, ["t1", "t2"])
        .withColumn("words", F.slice("words", F.col("at") + 1, F.col("n")))
    )
    keys = ["t1", "t2", "n", "at"]
    window_rows = None
    for k in lengths:
        rows = _shingles(marked.where(F.col("k") == k).withColumnRenamed("at", "start"), ["t1", "t2", "n", "start"], k)
        rows = rows.select("t1", "t2", "n", F.col("start").alias("at"), "h")
        window_rows = rows if window_rows is None else window_rows.unionByName(rows)
    window_rows = cut_lineage(window_rows, "window-shingles")
    window_prints = _fingerprint(window_rows, keys)
    item_prints = _fingerprint(item_rows, ["item", "n"])
    differences = _near_values(radius // BLOCKS)
    index = None
    for i in range(BLOCKS):
        entries = item_prints.select(
            "item", "n", F.col("print").alias("item_print"), F.col("size").alias("item_size"),
            F.lit(i).alias("block"), F.explode(differences).alias("_d"), _block(i).alias("_v"),
        ).select("item", "n", "item_print", "item_size", "block", F.col("_v").bitwiseXOR(F.col("_d")).alias("value"))
        index = entries if index is None else index.unionByName(entries)
    looked_up = window_prints.select(
        *keys, "size", "print",
        F.posexplode(F.array(*[_block(i) for i in range(BLOCKS)])).alias("block", "value"),
    )
    # The index is far larger than the few items it is made from suggest, so it is never broadcast.
    pairs = (
        looked_up.join(index.hint("merge"), ["n", "block", "value"])
        .where(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= radius)
        .select(*keys, "size", "item", "item_size")
        .distinct()
    )
    window_counts = window_rows.groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("_w"))
    item_counts = item_rows.groupBy("item", "h").agg(F.count(F.lit(1)).alias("_i"))
    common = F.sum(F.least("_w", "_i"))
    return (
        pairs.join(window_counts, keys)
        .join(item_counts, ["item", "h"])
        .groupBy("t1", "t2", "item", "at")
        .agg((common / (F.first("size") + F.first("item_size") - common)).alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-9)
        .join(keyed.select("item", "item_id"), "item")
        .select("t1", "t2", "item_id", "at", "similarity")
    )


def _ahead(hit_rows: DataFrame, wide: Column) -> DataFrame:
    """Adds ``_hits``: hits of the same text and size among the shingles of the window from ``at``.

    Positions are cut into blocks of ``wide + 1``, so a window lies in the block of its start and in the
    next one. Each hit is filed under its own block and under the one before it; no list is
    longer than an item, and the blocks of a long text are groups of their own.
    """
    order = ["t1", "t2", "n", "k"]
    block = F.floor(F.col("at") / (wide + 1))
    filed = hit_rows.select(
        *order, "at", F.posexplode(F.array(block, block - 1)).alias("_later", "_block")
    )
    at_in = lambda later: F.collect_list(F.when(F.col("_later") == later, F.col("at")))
    listed = filed.groupBy(*order, "_block").agg(F.sort_array(at_in(0)).alias("_own"), at_in(1).alias("_next"))
    counted = F.transform(
        "_own",
        lambda at, i: F.struct(
            at.alias("at"), (F.size("_own") - i + F.size(F.filter("_next", lambda x: x <= at + wide))).alias("_hits")
        ),
    )
    return listed.select(*order, F.inline(counted))


def text_keys() -> dict[str, Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)}


def contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, contaminated, item_ids, n_windows, best_similarity`` for every row of ``docs``.

    A document is contaminated if one of its windows reaches the similarity ``threshold``
    with an item. ``item_ids`` lists the items found, ascending.

    Needs ``doc_id, text`` and ``item_id, text``; other columns are not read. Null texts
    and texts without words match nothing. Items of fewer than five words are one shingle of
    all their words. Null ids are kept; an item without id is found but not listed. Repeated
    rows all get the result of their text, and repeated items count once. Texts of any
    length are searched whole. Empty tables give no rows or no findings.
    """
    found = (
        find_items(docs, items, threshold)
        .groupBy("t1", "t2")
        .agg(
            F.sort_array(F.collect_set("item_id")).alias("_items"),
            F.countDistinct("at").alias("_windows"),
            F.max("similarity").alias("_best"),
        )
    )
    return (
        docs.select("doc_id", *[c.alias(n) for n, c in text_keys().items()])
        .join(found, ["t1", "t2"], "left")
        .select(
            "doc_id", F.col("_best").isNotNull().alias("contaminated"),
            F.coalesce("_items", F.array().cast("array<bigint>")).alias("item_ids"),
            F.coalesce("_windows", F.lit(0)).cast("long").alias("n_windows"),
            F.coalesce("_best", F.lit(0.0)).alias("best_similarity"),
        )
    )


@query("op7_decontamination")
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
