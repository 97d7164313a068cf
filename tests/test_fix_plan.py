"""The sums of brackets of all files are no ground for a broadcast."""

from linewright.operators import fixes


def _broadcast_lists(node, inside=False) -> int:
    """Aggregates of lists below a broadcast, in the plan as it was run."""
    if node.nodeName() == "AdaptiveSparkPlan":
        return _broadcast_lists(node.executedPlan(), inside)
    if node.nodeName().endswith("QueryStage"):
        return _broadcast_lists(node.plan(), inside)
    inside = inside or node.nodeName() == "BroadcastExchange"
    children = node.children()
    return int(inside and node.nodeName() == "ObjectHashAggregate") + sum(
        _broadcast_lists(children.apply(i), inside) for i in range(children.size())
    )


def test_bracket_sums_are_not_broadcast(spark):
    keys = "review_id long, file_id long"
    placed = spark.createDataFrame(
        [(0, 1, 5, "javascript", 1, 2, [0, 0, 0], "}"), (0, 1, 6, "javascript", 1, 2, [0, 0, 0], "{ b")],
        f"{keys}, ord long, language string, _front int, _end int, _total array<long>, suggested_fix string",
    )
    facts = spark.createDataFrame([(0, 1, 2, [0, 0, 1]), (0, 1, 3, [0, 0, -1])], f"{keys}, line_no int, brackets array<long>")
    worse = fixes._unbalanced(placed, facts)
    assert [r.ord for r in worse.collect()] == [5]
    assert _broadcast_lists(worse._jdf.queryExecution().executedPlan()) == 0
