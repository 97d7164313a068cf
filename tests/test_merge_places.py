"""Places of findings that look around them over the edges of line blocks."""

import random

from pyspark.sql import functions as F

from linewright.operators import merging


def test_places_see_their_surroundings_once(spark):
    rng = random.Random(3)
    edge = merging.BLOCK_LINES
    rows = {(f, line): rng.randint(-9, 9) for f in (1, 2) for line in [*rng.sample(range(4 * edge), 90), 0, edge - 1, edge, 2 * edge]}
    places = spark.createDataFrame([(0, f, line, v) for (f, line), v in rows.items()], "review_id long, file_id long, line_start int, v int")
    seen = merging._looking_around(places, 6, low=F.min("v"), n=F.count("v"))
    want = {
        (f, line): (min(near), len(near))
        for f, line in rows
        for near in [[v for (g, other), v in rows.items() if g == f and abs(other - line) <= 6]]
    }
    got = seen.collect()
    assert {(r.file_id, r.line_start): (r.low, r.n) for r in got} == want and len(got) == len(rows)


def test_places_are_hardly_copied_on_the_way(spark):
    """One row for a place, two near an edge, where there was one for each line in reach."""
    places = spark.range(10 * merging.BLOCK_LINES).selectExpr("0L AS review_id", "1L AS file_id", "CAST(id AS INT) AS line_start", "1 AS v")
    merging_plan = merging._looking_around(places, 6, low=F.min("v"))
    assert merging_plan.count() == 10 * merging.BLOCK_LINES
    line = F.col("line_start")
    spread = places.select(F.size(F.sequence(merging._line_block(line - 6), merging._line_block(line + 6))).alias("n"))
    assert spread.agg(F.sum("n")).first()[0] < 1.25 * 10 * merging.BLOCK_LINES
