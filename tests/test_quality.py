"""Bugs and findings meet within the tolerance, over blocks of lines."""

import random

from linewright import fixed_values as fv
from linewright.operators import quality

PLACE = "review_id long, file_id long, category string, line_start int"


def _generated(node) -> int:
    """Rows that the explodes of an executed plan gave."""
    own = node.metrics().get("numOutputRows").get().value() if node.nodeName() == "Generate" else 0
    children = node.children()
    return own + sum(_generated(children.apply(i)) for i in range(children.size()))


def test_places_match_as_by_brute_force(spark):
    rng = random.Random(3)

    def places(n, low, high):
        return [
            (rng.randrange(2), rng.choice([1, 2, None]), rng.choice(["logic", "style", None]), rng.choice([None, *range(low, high)]))
            for _ in range(n)
        ]

    bugs = [(*p, i) for i, p in enumerate(places(300, -80, 400))]
    found = [(*p, i, rng.choice(["info", "critical"])) for i, p in enumerate(places(120, -90, 410))]
    # On both sides of a block's edge, just within and just out of reach, and at the ends of an int.
    edges = (0, 32, 64, 2**31 - 1 - fv.BUG_TOLERANCE, -(2**31) + fv.BUG_TOLERANCE)
    for edge in edges:
        found.append((7, 7, "edge", edge, len(found), "critical"))
        for off in (-6, -5, -1, 0, 5, 6):
            if -(2**31) <= edge + off < 2**31:
                bugs.append((7, 7, "edge", edge + off, len(bugs)))
    bug_rows = spark.createDataFrame(bugs, f"{PLACE}, bug_id long")
    rows = spark.createDataFrame(found, f"{PLACE}, ord long, severity string")

    def fits(a, b):
        return None not in (*a[:4], *b[:4]) and a[:3] == b[:3] and abs(a[3] - b[3]) <= fv.BUG_TOLERANCE

    want = {b[4]: any(fits(b, f) for f in found) for b in bugs}
    judged = quality.judged_bugs(bug_rows, rows)
    assert judged.columns == [*bug_rows.columns, "found"]
    assert {r.bug_id: r.found for r in judged.collect()} == want
    known = {b[:2] for b in bugs if None not in b[:2]}
    wrong = {f[4] for f in found if f[5] != "info" and f[:2] in known and not any(fits(b, f) for b in bugs)}
    told = quality.false_positives(rows, bug_rows)
    assert told.columns == rows.columns
    assert sorted(r.ord for r in told.collect()) == sorted(wrong)


def test_findings_are_not_spread_over_the_lines_around_them(spark):
    findings = spark.range(2000).selectExpr("0L AS review_id", "id % 7 AS file_id", "'logic' AS category", "CAST(id * 3 AS int) AS line_start")
    bugs = findings.where("line_start % 10 = 0")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = quality.recall_counts(bugs, findings)
        assert [tuple(r) for r in counts.collect()] == [(0, bugs.count(), 0)]
        assert _generated(counts._jdf.queryExecution().executedPlan()) <= 2 * findings.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
