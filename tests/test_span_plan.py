from linewright.operators import lint, structure

SCRIPT = "import a from 'x'\nimport b from 'y'; import c from 'x'\nimport {\n  d,\n} from 'x'\nimport e from 'z'"


def test_span_rules_read_each_text_once(spark):
    files = spark.createDataFrame(
        [(1, 1, "a.ts", "typescript", SCRIPT), (1, 2, "b.ts", "typescript", "import a from 'x'"), (1, 3, "c.js", "javascript", SCRIPT)],
        "review_id long, file_id long, filename string, language string, content string",
    )
    found = lint.span_findings(files)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    wanted = lint.duplicate_imports(structure.imports(files))
    got = found.where("rule_id = 'no-duplicate-imports'").select(*wanted.columns)
    assert sorted(got.collect()) == sorted(wanted.collect()) and got.count() == 4
