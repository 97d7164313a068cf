"""Mixing sources to target weights by Pareto order sampling (native)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.registry import free_name, query, table
from linewright.session import Steps, cut_lineage

#: Slices of the sampling order per source: a running sum sorts one slice at a time.
SLICES = 1 << 14
#: Gaps of fewer words are filled by folding the few rows that can matter.
FOLDED = 1000
#: No document is drawn with a higher probability; beyond it odds would leave few slices for many rows.
MOST_LIKELY = 0.95
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources take ``weights`` in turn in code-point order, null last. A target stops at ``most``
    times its source; what is over goes to the others by weight. Sources that stop are those
    with the smallest room per weight, so sorting by that ratio finds them in one pass: source
    k stops if its room is no more than its part of what the ones before it leave.
    The windows run over one row per source, never over documents.
    """
    ranked = sizes.withColumn(
        "_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    turns = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "_n").rowsBetween(Window.unboundedPreceding, -1)
    weighed = (
        ranked.withColumn("_w", F.element_at(turns, (F.col("_n") % len(weights) + 1).cast("int")))
        .withColumn("_room", F.lit(float(most)) * F.col("source_size"))
        .withColumn("_ratio", F.col("_room") / F.col("_w"))
        .withColumn("_all", F.lit(float(share)) * F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("_w").over(every))
    )
    left = F.col("_all") - F.coalesce(F.sum("_room").over(before), F.lit(0.0))
    weight_left = F.col("_weights") - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    stopped = weighed.withColumn("_stops", F.col("_room") * weight_left <= left * F.col("_w"))
    gone = F.sum(F.when(F.col("_stops"), F.col("_room")).otherwise(0.0)).over(every)
    gone_weight = F.sum(F.when(F.col("_stops"), F.col("_w")).otherwise(0.0)).over(every)
    rest = (F.col("_all") - gone) * F.col("_w") / (F.col("_weights") - gone_weight)
    return stopped.select(
        "source", "source_size", F.when(F.col("_stops"), F.col("_room")).otherwise(rest).alias("target")
    )


def _uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on nothing but the row: 52 bits of an MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _words_before(df: DataFrame, out: str) -> DataFrame:
    """Adds the words of the same source that come earlier in the sampling order.

    A slice of the order is sorted in one task, and only slice totals are summed per source, so
    a source with a third of all rows is spread over all tasks. ``_slice`` follows the order.
    """
    within = (
        Window.partitionBy("source", "_slice")
        .orderBy("_q", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        df.groupBy("source", "_slice")
        .agg(F.sum("size").alias("_sum"))
        .select(
            F.col("source").alias("_s"), F.col("_slice").alias("_b"),
            F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"),
        )
    )
    return (
        df.withColumn("_local", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(totals, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_b")))
        .withColumn(out, F.col("_base") + F.col("_local"))
        .drop("_s", "_b", "_base", "_local")
    )


def digits(size: Column) -> Column:
    """How readily a document is drawn: the binary digits of its word count, so fragments are repeated least."""
    return F.length(F.bin(size)).cast("long")


def _last_words(rest: DataFrame, gaps: DataFrame) -> DataFrame:
    """``_row`` of what still fits, in order, into gaps below ``FOLDED``.

    Of one size only the first gap/size rows can be taken, so a source has fewer than
    FOLDED * ln(FOLDED) + FOLDED candidates, which are folded as one sorted array. The literal
    limit lets each task cut its rows to that before they are shuffled.
    """
    turn = F.row_number().over(
        Window.partitionBy("source", "size").orderBy("_q", F.col("doc_id").asc_nulls_last(), "_row")
    )
    few = (
        rest.join(gaps, F.col("source").eqNullSafe(F.col("_source")))
        .where(F.col("size") <= F.col("_gap"))
        .withColumn("_turn", turn)
        .where((F.col("_turn") <= FOLDED) & (F.col("_turn") * F.col("size") <= F.col("_gap")))
    )
    place = F.struct("_q", F.col("doc_id").isNull().alias("none"), "doc_id", "size", "_row")
    listed = few.groupBy("source").agg(F.first("_gap").alias("_gap"), F.sort_array(F.collect_list(place)).alias("_all"))
    taken = F.aggregate(
        "_all",
        F.struct(F.col("_gap").alias("gap"), F.array().cast("array<bigint>").alias("rows")),
        lambda state, x: F.when(
            x["size"] <= state["gap"],
            F.struct((state["gap"] - x["size"]).alias("gap"), F.array_append(state["rows"], x["_row"]).alias("rows")),
        ).otherwise(state),
        lambda state: state["rows"],
    )
    return listed.select(F.explode(taken).alias("_row"))


def _filled(steps: Steps, rest: DataFrame, gaps: DataFrame) -> DataFrame:
    """``_row`` of what goes on in the order of ``rest`` with every document that still fits.

    While the gap of a source lies in [2**g, 2**(g+1)), smaller rows always fit and at most one
    of 2**g or more does. So one running sum of the smaller ones finds the row that brings the
    gap below 2**g, and there are at most as many rounds as a gap has bits. Gaps below ``FOLDED``
    need no rounds.
    """
    same = F.col("source").eqNullSafe(F.col("_source"))
    everything, taken, number = rest, rest.where(F.lit(False)).select("_row"), 0
    place = F.struct("_q", F.col("doc_id").isNull().alias("none"), "doc_id", "size", "_before", "_row")
    gaps = steps.write(gaps, "mix-gaps")
    while not gaps.where(F.col("_gap") >= FOLDED).isEmpty():
        fits = rest.join(gaps.where(F.col("_gap") >= FOLDED), same).where(F.col("size") <= F.col("_gap")).drop("_source")
        power = F.pow(F.lit(2.0), F.floor(F.log2("_gap")))
        banded = fits.withColumn("_words", F.col("size")).withColumn("_small", F.col("size") < power)
        summed = _words_before(
            banded.withColumn("size", F.when(F.col("_small"), F.col("size")).otherwise(0)), "_before"
        ).withColumn("size", F.col("_words"))
        left = F.col("_gap") - F.col("_before") - F.col("size")
        ends = F.when(F.col("_small"), left < power).otherwise(left >= 0)
        placed = steps.write(summed.drop("_words").withColumn("_ends", ends), f"mix-round-{number}")
        if placed.isEmpty():
            break
        last = placed.where("_ends").groupBy("source").agg(F.min(place).alias("_last")).select(
            F.col("source").alias("_source"), "_last"
        )
        upto = F.col("_last").isNull() | (place <= F.col("_last"))
        takes = F.when(F.col("_small"), upto).otherwise(place == F.col("_last"))
        settled = placed.join(last, same, "left").withColumn("_takes", F.coalesce(takes, F.lit(False)))
        taken = taken.union(settled.where("_takes").select("_row"))
        words = settled.where("_takes").groupBy("source").agg(F.sum("size").alias("_words"))
        gaps = steps.write(
            gaps.join(words, same, "left").select("_source", (F.col("_gap") - F.coalesce("_words", F.lit(0))).alias("_gap")),
            f"mix-gaps-{number}",
        )
        rest = settled.where(~F.col("_takes")).select("_row", "source", "doc_id", "size", "_q", "_slice")
        number += 1
    if number:
        taken = steps.write(taken, "mix-rounds")
        everything = everything.join(taken, "_row", "left_anti")
    return taken.union(_last_words(everything, gaps.where(F.col("_gap") < FOLDED)))


def _closing(first: DataFrame, taken: DataFrame) -> DataFrame:
    """``_row`` of the smallest document left of a source, where it overshoots by less than the gap is wide."""
    left = F.when(
        ~F.col("_first") & F.col("_more").isNull() & F.col("_open") & (F.col("size") > 0),
        F.struct("size", "_q", F.col("doc_id").isNull().alias("none"), "doc_id", "_row"),
    )
    reached = F.sum(F.when(F.col("_first") | F.col("_more").isNotNull(), F.col("size")).otherwise(0))
    return (
        first.join(taken.withColumn("_more", F.lit(True)), "_row", "left")
        .groupBy("source")
        .agg((F.first("_goal") - reached).alias("_gap"), F.min(left).alias("_next"))
        .where(F.col("_next.size") < 2 * F.col("_gap"))
        .select(F.col("_next._row").alias("_row"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: float = 3.0,
    seed: int = 17,
    prefer: Callable[[Column], Column] = digits,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` for every row of ``docs``.

    A source whose target is r times its size gives floor(r) certain copies of each document.
    The rest p = r - floor(r) is drawn with unequal probabilities: a document's is p times
    its preference over the mean preference of the source's words, at most 0.95. ``prefer``
    makes a whole number above 0 of the word count; larger ones are drawn more readily.
    Documents are ranked by the odds of a random number over the odds of their probability.
    The sample's fixed size is counted in words, so that long documents do not move a source
    off its target: it takes documents in that order up to the size, goes past one that would
    overshoot, and takes every later one that still fits. The smallest document left is taken too if that
    brings the source closer. So a source misses its target by at most half of its smallest
    document left, or has none left.

    Needs ``doc_id, text, source``; other columns are not read. Null or blank texts have size
    0 and are taken 0 words. Null sources are one source, the last. Null ids are ranked as
    one id. Equal rows tie, and which of them is taken makes no difference to the rows that
    come out. An empty table gives no rows. Random numbers come from ``seed`` and the id, so
    reruns agree whatever the partitions are.
    """
    with Steps(docs.sparkSession) as steps:
        # Texts are read once; what follows sees ids and sizes only.
        sized = steps.write(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
        totals = sized.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.sum(F.col("size") * prefer(F.col("size"))).alias("_preferred")
        )
        targets = (
            target_sizes(totals.drop("_preferred"), weights, share, most)
            .withColumnRenamed("source", "_source")
            .join(totals.select(F.col("source").alias("_s"), "_preferred"), F.col("_source").eqNullSafe(F.col("_s")))
            .drop("_s")
        )
        odds = lambda x: x / (1 - x)
        rated = (
            sized.join(targets, F.col("source").eqNullSafe(F.col("_source")))
            .drop("_source")
            .withColumn("_rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
            .withColumn("_whole", F.floor("_rate").cast("long"))
            .withColumn("_p", F.col("_rate") - F.col("_whole"))
            .withColumn("_open", F.col("_p") > 0)
            .withColumn("_goal", F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 1e-6).cast("long"))
            .withColumn("_u", _uniform(seed, F.col("doc_id")))
            .withColumn(
                "_chance",
                F.least(F.col("_p") * prefer(F.col("size")) * F.col("source_size") / F.nullif("_preferred", F.lit(0)), F.lit(MOST_LIKELY)),
            )
            .withColumn("_q", F.when(F.col("_open"), odds(F.col("_u")) / odds(F.col("_chance"))))
            # The rank times the odds that all documents of a source share is close to the odds of u, so its
            # slices hold about as many rows each, and they follow the ranking.
            .withColumn("_even", F.col("_q") * odds(F.least("_p", F.lit(0.5))))
            .withColumn(
                "_slice",
                F.floor(F.coalesce(F.col("_even") / (1 + F.col("_even")), F.col("_u")) * SLICES).cast("int"),
            )
            .drop("_rate", "_p", "_u", "_chance", "_even")
        )
        ranked = _words_before(rated, "_before").withColumn(
            "_first", F.col("_open") & (F.col("_before") + F.col("size") <= F.col("_goal"))
        )
        first = cut_lineage(ranked.drop("_before").withColumn("_row", F.monotonically_increasing_id()), "mix-first")
        gaps = first.groupBy("source").agg(
            (F.first("_goal") - F.sum(F.when(F.col("_first"), F.col("size")).otherwise(0))).alias("_gap")
        ).select(F.col("source").alias("_source"), "_gap")
        rest = first.where(~F.col("_first") & F.col("_open") & (F.col("size") > 0)).select(
            "_row", "source", "doc_id", "size", "_q", "_slice"
        )
        taken = steps.write(_filled(steps, rest, gaps), "mix-filled")
        more = cut_lineage(taken.union(_closing(first, taken)), "mix-taken")
    copies = F.col("_whole") + F.when(F.col("_first") | F.col("_more").isNotNull(), 1).otherwise(0)
    return (
        first.join(more.withColumn("_more", F.lit(True)), "_row", "left")
        .withColumn("copies", copies)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all its columns.

    Copies are decided per id, source and size; rows that agree in these are numbered by a hash of their
    text, so that each gets its own decision, and the same one in every run. Rows that are taken no time are
    absent. Null ids and sources are values of their own, null texts have no words and are never taken, an
    empty table gives no rows, and columns may have any names.
    """
    names = [free_name(docs, n) for n in ("_id", "_src", "_words", "_no")]
    copy = free_name(docs, "_copy")
    key = [F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.coalesce(F.xxhash64("source"), F.lit(0))]
    number = Window.partitionBy(*names[:3])
    marked = docs.withColumns(dict(zip(names, [*key, word_count(F.col("text"))]))).withColumn(
        names[3], F.row_number().over(number.orderBy(F.xxhash64("text"), F.xxhash64("text", F.lit(1))))
    )
    decided = mix(docs, **settings)
    counts = decided.select(
        *[c.alias(n) for c, n in zip([*key, F.col("size")], names)], F.col("copies").alias(copy)
    ).withColumn(names[3], F.row_number().over(number.orderBy(F.desc(copy))))
    return (
        marked.join(counts.where(F.col(copy) > 0), names)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int"))))
        .select(*docs.columns)
    )


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * length(bin(size))) AS BIGINT) AS preferred
      FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
w AS (SELECT *, CAST(n % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS room FROM n),
r AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS ws,
        coalesce(sum(room) OVER o, 0.0) AS room_before, coalesce(sum(w) OVER o, 0.0) AS w_before
      FROM w WINDOW o AS (ORDER BY room / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, room * (ws - w_before) <= (total - room_before) * w AS stops FROM r),
q AS (SELECT *, sum(CASE WHEN stops THEN room ELSE 0 END) OVER () AS gone,
        sum(CASE WHEN stops THEN w ELSE 0 END) OVER () AS gone_w FROM p),
t AS (SELECT n, source, source_size, preferred,
        CASE WHEN stops THEN room ELSE (total - gone) * w / (ws - gone_w) END AS target FROM q),
a AS (SELECT t.n, d.doc_id, d.size, t.source_size, t.target, t.preferred,
        CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
        (CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE)
          / 4503599627370496::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, rate - floor(rate) AS pr,
        CAST(floor(target - floor(rate) * source_size + 0.000001::DOUBLE) AS BIGINT) AS goal FROM a),
c AS (SELECT *, CASE WHEN pr > 0 THEN least(pr * length(bin(size)) * source_size / preferred, 0.95::DOUBLE) END AS chance
      FROM b),
o AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS q FROM c),
e AS MATERIALIZED (SELECT *, row_number() OVER w AS k, pr > 0 AND coalesce(sum(size) OVER
        (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size <= goal AS first
      FROM o WINDOW w AS (PARTITION BY n ORDER BY q, doc_id NULLS LAST, size)),
f AS MATERIALIZED (SELECT n, CAST(any_value(goal) - sum(CASE WHEN first THEN size ELSE 0 END) AS BIGINT) AS gap FROM e GROUP BY n),
g AS MATERIALIZED (SELECT e.n, e.k, e.size, row_number() OVER (PARTITION BY e.n ORDER BY e.k) AS turn FROM e JOIN f ON e.n = f.n
      WHERE NOT first AND pr > 0 AND size > 0 AND size <= gap),
h AS (SELECT n, 0 AS turn, CAST(0 AS BIGINT) AS k, gap, false AS fits FROM f
      UNION ALL
      SELECT g.n, g.turn, g.k, h.gap - CASE WHEN g.size <= h.gap THEN g.size ELSE 0 END, g.size <= h.gap
      FROM h JOIN g ON g.n = h.n AND g.turn = h.turn + 1),
m AS MATERIALIZED (SELECT n, k, fits, min(gap) OVER (PARTITION BY n) AS gap FROM h),
x AS MATERIALIZED (SELECT e.*, e.first OR coalesce(m.fits, false) AS takes FROM e LEFT JOIN m ON e.n = m.n AND e.k = m.k),
y AS (SELECT x.n, x.k, x.size < 2 * z.gap AS closer,
        row_number() OVER (PARTITION BY x.n ORDER BY x.size, x.q, x.doc_id NULLS LAST) AS place
      FROM x JOIN (SELECT DISTINCT n, gap FROM m) z ON x.n = z.n WHERE NOT x.takes AND x.pr > 0 AND x.size > 0)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN takes OR coalesce(closer, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x LEFT JOIN y ON x.n = y.n AND x.k = y.k AND y.place = 1
"""


@query("op4_source_mixing", ORACLE)
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
