"""Merging the findings of several detectors."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators.groups import gather, whole_groups
from linewright.operators.line_blocks import line_blocks, read_ranges
from linewright.operators.spread import running_rank, running_sum_before
from linewright.session import Steps, cut_lineage

FILE = ["review_id", "file_id"]
PLACE = [*FILE, "line_start"]
REACH = fv.MERGE_TOLERANCE
# Arrival numbers of one detector lie between two multiples of this.
TURN = 1 << 48
# An absorber of one line and source ends on one of the lines in reach, each at most once.
MAX_ABSORBERS = 2 * REACH + 1
# Lines whose places look around them together.
BLOCK_LINES = 64


def union_findings(*sources: DataFrame) -> DataFrame:
    """Findings of all detectors, static ones first; a detector without rows adds none.

    ``ord`` becomes the arrival order of the whole: position of the detector in the high
    bits, its own order below.
    """
    staged = [
        df.withColumn("ord", F.lit(i).cast("long") * TURN + F.col("ord"))
        for i, df in enumerate(sources)
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), staged)


def _neighbours(line: Column) -> Column:
    return F.explode(F.sequence(line - REACH, line + REACH))


def cross_source_agreement(findings: DataFrame) -> DataFrame:
    """Adds ``confirmed``: some other source has a finding within three lines.

    Findings shrink to one row per place and source before anything is compared. Each
    place then tells its neighbours which sources it has, so no finding meets another. If
    all sources around are the own one, the smallest and the largest of them are.
    """
    code = F.xxhash64("source")
    seen = findings.select(*PLACE, code.alias("_code")).distinct()
    around = (
        seen.select(*FILE, _neighbours(F.col("line_start")).alias("line_start"), "_code")
        .groupBy(*PLACE)
        .agg(F.min("_code").alias("_low"), F.max("_code").alias("_high"))
    )
    return (
        findings.join(around, PLACE)
        .withColumn("confirmed", (F.col("_low") != code) | (F.col("_high") != code))
        .drop("_low", "_high")
    )


def merged_severity(a: Column, b: Column) -> Column:
    """The higher of two severities; agreement lifts a warning to critical."""
    higher = F.when(text.rank(fv.SEVERITY_RANK, a) >= text.rank(fv.SEVERITY_RANK, b), a).otherwise(b)
    return F.when(higher == "warning", "critical").otherwise(higher)


def merge_pair(a: str, b: str) -> list[Column]:
    """Columns of the record that two finding structs merge into."""
    left, right = F.col(a), F.col(b)
    first = text.rank(fv.SOURCE_RANK, left["source"]) >= text.rank(fv.SOURCE_RANK, right["source"])

    def primary(field: str) -> Column:
        return F.when(first, left[field]).otherwise(right[field])

    def secondary(field: str) -> Column:
        return F.when(first, right[field]).otherwise(left[field])

    return [
        F.lit("merged").alias("source"),
        primary("category").alias("category"),
        merged_severity(left["severity"], right["severity"]).alias("severity"),
        primary("message").alias("message"),
        primary("line_start").alias("line_start"),
        primary("line_end").alias("line_end"),
        F.coalesce(F.nullif(left["rule_id"], F.lit("")), right["rule_id"]).alias("rule_id"),
        F.coalesce(
            F.nullif(primary("suggested_fix"), F.lit("")), secondary("suggested_fix")
        ).alias("suggested_fix"),
        F.coalesce(primary("confidence"), secondary("confidence")).alias("confidence"),
        primary("filename").alias("filename"),
    ]


# --- assignment: which finding folds into which -------------------------------------
#
# The merge of a file goes through its findings in arrival order. A finding still free
# takes the first later free one of another source in reach (its *lead-in*), settles on
# the line of the higher-ranked of the two, and from the lead-in on takes every free
# finding of another source in reach of that line. So what is taken of one line and source
# is always everything from some arrival on: one number per line and source is the whole
# state, and each finding belongs to the earliest absorber that reaches it.


def greedy_owners(lines, sources, ranks) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Owner and lead of each finding of one file, given in arrival order.

    Returns positions: ``owner[i]`` is the finding that ``i`` ends in, ``lead[i]`` the one
    that owner takes its text from. The absorbers come as ``(position, line, lead-in, main)``.
    """
    owner = np.arange(len(lines))
    lead = np.arange(len(lines))

    def take(taken: list[int], i: int, main: int) -> None:
        owner[taken] = i
        lead[taken] = main

    absorbers = greedy_absorbers(lines, sources, ranks, take)
    for i, _, _, main in absorbers:
        lead[i] = main
    return owner, lead, absorbers


def greedy_absorbers(lines, sources, ranks, take: Callable[[list[int], int, int], None] | None = None) -> list[tuple]:
    """The absorbers among findings in arrival order: ``(position, line, lead-in, main)``.

    ``take`` is told the findings of one place that an absorber takes, for callers that ask for them.
    """
    n = len(lines)
    # Of each line, the arrivals of every source.
    places: dict[int, dict[int, list[int]]] = {}
    for i in range(n):
        places.setdefault(lines[i], {}).setdefault(sources[i], []).append(i)
    absorbers: list[tuple[int, int, int, int]] = []
    if len(set(sources)) < 2:
        return absorbers
    free_until: dict[tuple[int, int], int] = {}
    closed: set[tuple[int, int]] = set()
    nothing: dict[int, list[int]] = {}
    for i in range(n):
        line, source = lines[i], sources[i]
        if (line, source) in closed or i >= free_until.get((line, source), n):
            continue
        lead_in = n
        for near in range(line - REACH, line + REACH + 1):
            for other, arrivals in places.get(near, nothing).items():
                if other != source and arrivals[-1] > i:
                    at = bisect_right(arrivals, i)
                    if arrivals[at] < lead_in and arrivals[at] < free_until.get((near, other), n):
                        lead_in = arrivals[at]
        if lead_in == n:
            closed.add((line, source))  # later ones of this place see even less
            continue
        main = i if ranks[i] >= ranks[lead_in] else lead_in
        settled = lines[main]
        absorbers.append((i, settled, lead_in, main))
        for near in range(settled - REACH, settled + REACH + 1):
            for other, arrivals in places.get(near, nothing).items():
                if other != source:
                    until = free_until.get((near, other), n)
                    if lead_in < until:
                        if take is not None:
                            take(arrivals[bisect_right(arrivals, lead_in - 1):bisect_right(arrivals, until - 1)], i, main)
                        free_until[(near, other)] = lead_in
    return absorbers


def _codes(df: DataFrame) -> DataFrame:
    """``_src`` tells sources apart, by a hash of the name; ``_rank`` orders them."""
    return df.withColumn("_src", F.xxhash64(F.coalesce("source", F.lit("")))).withColumn(
        "_rank", text.rank(fv.SOURCE_RANK, F.col("source"))
    )


def _absorber_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The absorbers of every island; rows come sorted by island and arrival."""
    for rows, bounds in whole_groups(batches, [*FILE, "_island"]):
        arrivals = rows.column("ord").to_numpy()
        lines, sources, ranks = (rows.column(c).to_pylist() for c in ("line_start", "_src", "_rank"))
        at, settled, since, main = [], [], [], []
        for low, high in bounds:
            for i, line, lead_in, lead in greedy_absorbers(lines[low:high], sources[low:high], ranks[low:high]):
                at.append(low + i)
                settled.append(line)
                since.append(low + lead_in)
                main.append(low + lead)
        at, since, main = (np.array(values, dtype=np.int64) for values in (at, since, main))
        absorbing = rows.select([*FILE, "_src"]).take(pa.array(at))
        for name, values in (
            ("_line", pa.array(settled, pa.int32())),
            ("_absorber", pa.array(arrivals[at])),
            ("_from", pa.array(arrivals[since])),
            ("_main", pa.array(arrivals[main])),
        ):
            absorbing = absorbing.append_column(name, values)
        yield from absorbing.to_batches()


def _looking_around(places: DataFrame, reach: int, **told: Column) -> DataFrame:
    """Adds to each place, one row each, what the ``told`` aggregates say of the places of its file within ``reach`` lines.

    The places of a file are dealt out by blocks of lines; one near an edge goes to both blocks. So a
    window sees at most the distinct lines of a block and its edges, and hardly a place is copied.
    """
    line = F.col("line_start")
    around = Window.partitionBy(*FILE, "_block").orderBy("line_start").rangeBetween(-reach, reach)
    return (
        places.withColumn("_block", F.explode(F.sequence(_line_block(line - reach), _line_block(line + reach))))
        .withColumns({name: column.over(around) for name, column in told.items()})
        .where(F.col("_block") == _line_block(line))
        .drop("_block")
    )


def _line_block(line: Column) -> Column:
    return F.floor(line / BLOCK_LINES).cast("long")


def _absorbers(narrow: DataFrame, steps: Steps) -> DataFrame:
    """The findings that others end in, from the narrow rows alone; what is asked several times is written once."""
    spots = [*PLACE, "_src"]
    # An absorber lies within twice the reach of all it takes, so a place with no other
    # source that near is out of the game.
    ends = narrow.groupBy(*PLACE).agg(F.min("_src").alias("_low"), F.max("_src").alias("_high"))
    near = _looking_around(ends, 2 * REACH, _least=F.min("_low"), _most=F.max("_high"))
    meeting = near.where(F.col("_least") < F.col("_most")).select(*PLACE)
    items = steps.write(narrow.join(meeting, PLACE, "left_semi"), "merge-items")

    by_arrival = Window.partitionBy(*spots).orderBy("ord")
    first = (
        items.withColumn("_n", F.row_number().over(by_arrival))
        .where(F.col("_n") <= MAX_ABSORBERS)
        .drop("_n")
    )
    # Every place with items has its first ones, so the places that ask are those that are asked.
    asked = first.groupBy(*PLACE).agg(F.collect_list("ord").alias("_ords"))
    asking = _looking_around(asked, REACH, _heard=F.collect_list("_ords")).select(
        *PLACE, F.array_sort(F.flatten("_heard")).alias("_asked")
    )
    nexts = (
        items.join(asking, PLACE)
        .withColumn("_after", F.size(F.filter("_asked", lambda asked: asked < F.col("ord"))))
        .groupBy(*spots, "_rank", "_after")
        .agg(F.min("ord").alias("ord"))
        .drop("_after")
    )
    short = steps.write(first.unionByName(nexts).distinct(), "merge-short")

    # A line starts an island if none of the lines in reach above it has a finding. Lines
    # tell that to the ones below them, so no task sees all lines of a file.
    told = [
        F.struct((F.col("line_start") + step).alias("line_start"), F.lit(step == 0).alias("own"))
        for step in range(REACH + 1)
    ]
    starts = (
        short.select(*PLACE).distinct()
        .select(*FILE, F.explode(F.array(*told)).alias("t"))
        .select(*FILE, "t.*")
        .groupBy(*PLACE)
        .agg(F.bool_or("own").alias("_own"), F.bool_and("own").cast("long").alias("_start"))
        .where("_own")
        .drop("_own")
    )
    islands = running_sum_before(starts, FILE, "line_start", "_start", "_island").withColumn(
        "_island", F.col("_island") + F.col("_start")
    )
    return (
        gather(short.join(islands.drop("_start"), PLACE), [*FILE, "_island"], "ord")
        .mapInArrow(
            _absorber_batches,
            "review_id long, file_id long, _src long, _line int, _absorber long, _from long, _main long",
        )
    )


def assign(findings: DataFrame) -> DataFrame:
    """Adds ``_owner`` and ``_lead``, arrival numbers of the finding each one ends in.

    ``ord`` must be unique within a file. No group is larger than the distinct lines of an
    island. Only the first few findings of a line and source can absorb (their end lines differ
    and lie in reach), and all they need of others is the next arrival after their own.
    So each line and source is cut down to those, the loop runs on them where sources
    meet, and every finding looks its owner up in the short list of absorbers around it.
    """
    coded = _codes(findings)
    with Steps(findings.sparkSession) as steps:
        absorbers = cut_lineage(_absorbers(steps.write(coded.select(*PLACE, "_src", "_rank", "ord"), "merge-narrow"), steps), "absorbers")
    reached = (
        absorbers.select(
            *FILE,
            _neighbours(F.col("_line")).alias("line_start"),
            F.struct(
                F.col("_absorber").alias("owner"), F.col("_main").alias("lead"),
                F.col("_src").alias("src"), F.col("_from").alias("since"),
            ).alias("_a"),
        )
        .groupBy(*PLACE)
        .agg(F.collect_list("_a").alias("_near"))
    )
    mine = F.filter(
        "_near",
        lambda a: (a["owner"] == F.col("ord"))
        | ((a["src"] != F.col("_src")) & (F.col("ord") >= a["since"])),
    )
    return (
        coded.join(reached, PLACE, "left")
        .withColumn("_pick", F.array_min(mine))
        .withColumn("_owner", F.coalesce("_pick.owner", "ord"))
        .withColumn("_lead", F.coalesce("_pick.lead", "ord"))
        .drop("_near", "_pick")
    )


def merge_assigned(assigned: DataFrame) -> DataFrame:
    """One record per owner; an aggregate with a map-side half, so an owner may be huge."""
    following = F.struct(F.col("ord") != F.col("_lead"), F.col("ord"))
    lead_fields = ["filename", "category", "message", "line_start", "line_end", "source", "severity"]

    def earliest(column: str, empty: str | None = None) -> Column:
        """First usable value, the lead's own before the others in arrival order."""
        usable = F.col(column).isNotNull()
        if empty is not None:
            usable = usable & (F.col(column) != empty)
        return F.min(F.when(usable, F.struct(following.alias("place"), F.col(column).alias("value"))))

    grouped = assigned.groupBy(*FILE, "_owner").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.struct(following.alias("place"), *lead_fields)).alias("main"),
        F.max((F.col("severity") != "info").cast("int")).alias("grave"),
        F.min(
            F.when(F.coalesce("rule_id", F.lit("")) != "", F.struct("ord", "rule_id"))
        ).alias("rule"),
        earliest("suggested_fix", "").alias("fix"),
        earliest("confidence").alias("sure"),
    )
    alone = F.col("members") == 1
    return grouped.select(
        *FILE,
        F.col("main.filename").alias("filename"),
        F.when(alone, F.col("main.source")).otherwise("merged").alias("source"),
        F.col("main.category").alias("category"),
        F.when(alone, F.col("main.severity"))
        .when(F.col("grave") == 1, "critical")
        .otherwise("info")
        .alias("severity"),
        F.col("main.message").alias("message"),
        F.col("main.line_start").alias("line_start"),
        F.col("main.line_end").alias("line_end"),
        F.col("rule.rule_id").alias("rule_id"),
        F.col("fix.value").alias("suggested_fix"),
        F.col("sure.value").alias("confidence"),
        F.col("_owner").alias("ord"),
        "members",
    )


def merge_findings(findings: DataFrame) -> DataFrame:
    """Greedy merge of each file's findings in arrival order."""
    return merge_assigned(assign(findings))


def attach_snippets(findings: DataFrame, files: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Adds ``code_snippet``: a finding's lines with two lines of context on each side.

    Findings meet the number of lines of their file, then the blocks of lines that their range lies in.
    So no content is joined to a finding or split for it, and a file is cut into blocks once,
    however many findings it has. ``blocks`` are those of ``line_blocks``, if there are some already.
    Files that are missing or empty give no snippet; a range behind the last line gives an empty one.
    """
    wanted = findings.drop("code_snippet")
    content = F.nullif("content", F.lit(""))
    counts = files.where(content.isNotNull()).select(*FILE, text.line_count(content).alias("_n"))
    ranged = (
        wanted.join(counts, FILE, "left")
        .withColumn("_from", F.greatest(F.col("line_start") - 3, F.lit(0)))
        .withColumn("_to", F.least(F.col("_n"), F.col("line_end") + 2))
    )
    inside = F.col("_n").isNotNull() & (F.col("_to") > F.col("_from"))
    if blocks is None:
        blocks = line_blocks(files)
    read = read_ranges(ranged.where(inside), blocks)
    return (
        ranged.join(read, [*FILE, "_from", "_to"], "left")
        .withColumn("code_snippet", F.when(F.col("_n").isNotNull(), F.coalesce("_text", F.lit(""))))
        .drop("_n", "_from", "_to", "_text")
    )


def order_findings(findings: DataFrame) -> DataFrame:
    """Gravest first, then by line, then by arrival: a range-partitioned sort."""
    return findings.orderBy(
        F.desc(text.rank(fv.SEVERITY_RANK, F.col("severity"))), "line_start", "ord"
    )


def finding_positions(findings: DataFrame) -> DataFrame:
    """Adds ``position``, the place of a finding in its review's ordered list.

    It is the sum of three counts: graver findings, equal ones on earlier lines, and the
    rank on the own line; each of them is taken over bounded blocks.
    """
    keys = ["review_id", "severity"]
    lines = findings.groupBy(*keys, "line_start").agg(F.count(F.lit(1)).alias("_n"))
    lines = running_sum_before(lines, keys, "line_start", "_n", "_earlier").drop("_n")
    totals = findings.groupBy("review_id").agg(
        *[F.count_if(F.col("severity") == s).alias(f"_{s}") for s in ("critical", "warning")]
    )
    graver = (
        F.when(F.col("severity") == "critical", 0)
        .when(F.col("severity") == "warning", F.col("_critical"))
        .otherwise(F.col("_critical") + F.col("_warning"))
    )
    ranked = running_rank(findings, [*keys, "line_start"], "ord", "_rank")
    return (
        ranked.join(lines, [*keys, "line_start"])
        .join(totals, "review_id")
        .withColumn("position", (F.col("_rank") + F.col("_earlier") + graver).cast("long"))
        .drop("_rank", "_earlier", "_critical", "_warning")
    )
