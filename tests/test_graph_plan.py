"""Import candidates are many per source and take no part in a broadcast."""

from linewright.operators import graph


def _broadcast_generates(node, inside=False) -> int:
    """Generates below a broadcast whose rows no aggregate has drawn together again."""
    inside = node.nodeName() == "BroadcastExchange" or (inside and "Aggregate" not in node.nodeName())
    children = node.children()
    return int(inside and node.nodeName() == "Generate") + sum(
        _broadcast_generates(children.apply(i), inside) for i in range(children.size())
    )


def test_candidates_are_not_broadcast(spark):
    files = spark.range(30000).selectExpr("id % 3 AS review_id", "id AS file_id", "concat('f', id, '.ts') AS filename")
    imports = files.where("file_id < 40").selectExpr(
        "review_id", "file_id", "1 AS line_no", "concat('./f', file_id + 3) AS source", "true AS is_relative"
    )
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        resolved = graph.resolve_imports(imports, files)
        got = sorted((r.file_id, r.target_id, r.target) for r in resolved.collect())
        assert got == [(i, i + 3, f"f{i + 3}.ts") for i in range(40)]
        assert _broadcast_generates(resolved._jdf.queryExecution().executedPlan()) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
