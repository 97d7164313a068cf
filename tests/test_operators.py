"""Operators on small cases and against plain Python models."""

import random

import pytest
from pyspark.sql import functions as F

from linewright.operators import (
    batching, edits, fixes, graph, lint, merging, plugins, quality, responses, reuse, scan, scoring,
    spread, structure,
)
from linewright.operators import code_shape
from linewright.sources import code_corpus

FINDING = (
    "review_id long, file_id long, filename string, source string, category string, severity string, "
    "message string, line_start int, line_end int, rule_id string, suggested_fix string, "
    "confidence double, ord long"
)


def finding(line, source, ord, severity="warning", rule=None, message=None, fix=None, file=1, category="logic", sure=None):
    return (1, file, f"f{file}.ts", source, category, severity, message or f"m{ord}", line, line, rule, fix, sure, ord)


def merged(spark, rows, **options):
    df = merging.merge_findings(spark.createDataFrame(rows, FINDING), **options)
    return sorted(df.collect(), key=lambda r: r.ord)


def test_merge_cases(spark):
    one = merged(spark, [finding(10, "pattern", 0), finding(12, "llm", 1)])
    assert [(r.source, r.severity, r.line_start) for r in one] == [("merged", "critical", 12)]
    two = merged(spark, [finding(5, "pattern", 0), finding(10, "llm", 1)])
    assert len(two) == 2
    rule = merged(spark, [finding(5, "eslint", 0, rule="no-eval"), finding(5, "llm", 1, message="why")])
    assert [(r.rule_id, r.message) for r in rule] == [("no-eval", "why")]
    info = merged(spark, [finding(5, "eslint", 0, "info"), finding(5, "llm", 1, "info")])
    assert info[0].severity == "info"


RANK = {"merged": 4, "llm": 3, "eslint": 2, "pattern": 1}


def model_merge(rows):
    """The loop as stated: later free findings of another source fold into the current one."""
    used, out = set(), []
    for i, first in enumerate(rows):
        if i in used:
            continue
        cur = dict(first)
        for j in range(i + 1, len(rows)):
            other = rows[j]
            if j in used or first["source"] == other["source"] or abs(cur["line"] - other["line"]) > 3:
                continue
            used.add(j)
            main, side = (cur, other) if RANK[cur["source"]] >= RANK[other["source"]] else (other, cur)
            worst = max(cur["severity"], other["severity"], key=("info", "warning", "critical").index)
            cur = {
                "source": "merged", "line": main["line"], "message": main["message"],
                "severity": "critical" if worst == "warning" else worst,
                "rule": cur["rule"] or other["rule"], "fix": main["fix"] or side["fix"],
                "sure": main["sure"] if main["sure"] is not None else side["sure"],
            }
        out.append(cur)
    return sorted((r["source"], r["line"], r["message"], r["severity"], r["rule"], r["fix"], r["sure"]) for r in out)


def test_merge_matches_model(spark):
    """Both forms of the assignment, from sparse files to lines with many findings."""
    rng = random.Random(7)
    rows, models = [], {}
    for file in range(120):
        span, count = rng.choice([(60, 12), (15, 25), (6, 60), (3, 40)])
        items = []
        for ord in range(count):
            item = {
                "line": rng.randint(1, span), "source": rng.choice(["pattern", "eslint", "llm"]),
                "severity": rng.choice(["info", "info", "warning", "critical"]), "message": f"m{ord}",
                "rule": rng.choice([None, "r1", "r2"]), "fix": rng.choice([None, None, "f1"]),
                "sure": rng.choice([None, 0.5]),
            }
            items.append(item)
            rows.append(finding(item["line"], item["source"], ord, item["severity"], item["rule"], item["message"],
                                item["fix"], file, sure=item["sure"]))
        models[file] = model_merge(items)
    got = {file: [] for file in models}
    df = merging.merge_findings(spark.createDataFrame(rows, FINDING).repartition(7))
    for r in df.collect():
        got[r.file_id].append((r.source, r.line_start, r.message, r.severity, r.rule_id, r.suggested_fix, r.confidence))
    key = lambda t: tuple(str(x) for x in t)
    for file, want in models.items():
        assert sorted(got[file], key=key) == sorted(want, key=key), file


def test_order(spark):
    rows = [finding(1, "llm", 0, "info"), finding(10, "llm", 1, "critical"), finding(5, "llm", 2, "critical"), finding(3, "llm", 3)]
    placed = merging.finding_positions(spark.createDataFrame(rows, FINDING))
    assert [(r.severity, r.line_start) for r in placed.orderBy("position").collect()] == [
        ("critical", 5), ("critical", 10), ("warning", 3), ("info", 1)
    ]


@pytest.mark.parametrize(
    "severities,want",
    [([], 100), (["critical"], 75), (["critical"] * 4, 0), (["critical"] * 5, 0), (["warning"], 90),
     (["info"], 98), (["critical", "warning", "info"], 63)],
)
def test_file_health(spark, severities, want):
    files = spark.createDataFrame([(1, 1)], "review_id long, file_id long")
    rows = spark.createDataFrame([(1, 1, s) for s in severities], "review_id long, file_id long, severity string")
    assert scoring.file_health(files, rows).first().health_score == want


@pytest.mark.parametrize("pairs,want", [([(100, 100), (50, 100)], 75), ([(100, 900), (0, 100)], 90), ([(10, 0)], 100)])
def test_project_score(spark, pairs, want):
    scored = spark.createDataFrame([(1, h, n) for h, n in pairs], "review_id long, health_score int, lines_of_code int")
    assert scoring.project_score(scored).first().project_score == want


def test_running_sum_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(spread, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(k, o, rng.randint(-5, 5)) for k in (1, 2) for o in rng.sample(range(200), 60)]
    df = spread.running_sum_before(spark.createDataFrame(rows, "k int, o long, v long"), ["k"], "o", "v", "s")
    for r in df.collect():
        assert r.s == sum(v for k, o, v in rows if k == r.k and o < r.o)


def test_adjust_lines(spark):
    moved = spark.createDataFrame([(1, 5, 1, 3), (1, 15, 2, 1)], "file_id long, original_line int, removed int, inserted int")
    lines = spark.createDataFrame([(1, 20), (1, 10), (1, 5), (2, 9)], "file_id long, line int")
    got = {(r.file_id, r.line): r.adjusted for r in edits.adjust_lines(lines, moved, ["file_id"]).collect()}
    assert got == {(1, 20): 21, (1, 10): 12, (1, 5): 5, (2, 9): 9}


def test_apply_in_sequence_matches_model(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for file in range(6):
        done = []
        for ord in range(40):
            start = rng.randint(1, 30)
            end = start + rng.randint(0, 3)
            fix = rng.choice([None, "", "a", "a\nb\nc"])
            want[file, ord] = tuple(x + sum(d for line, d in done if line < x) for x in (start, end))
            if fix:
                done.append((start, len(fix.split("\n")) - (end - start + 1)))
            rows.append((1, file, start, end, fix, ord))
    df = spark.createDataFrame(rows, "review_id long, file_id long, line_start int, line_end int, suggested_fix string, ord long")
    got = edits.apply_in_sequence(df, ["review_id", "file_id"])
    assert {(r.file_id, r.ord): (r.new_start, r.new_end) for r in got.collect()} == want


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(0, 64)]
    star = [(100, i) for i in range(101, 160)]
    files = spark.range(0, 170).selectExpr("CAST(1 AS BIGINT) AS review_id", "id AS file_id")
    links = spark.createDataFrame(chain + star + [(160, 160)], "src long, dst long")
    got = {r.file_id: r.component_id for r in graph.connected_components(files, links).collect()}
    assert all(got[i] == 0 for i in range(65))
    assert all(got[i] == 100 for i in range(100, 160))
    assert all(got[i] == i for i in (*range(65, 100), *range(160, 170)))


def test_resolve_module(spark):
    files = spark.createDataFrame([(1, 1, "views.py"), (1, 2, "models.py"), (1, 3, "a.ts")], "review_id long, file_id long, filename string")
    imports = spark.createDataFrame(
        [(1, 1, ".models", True), (1, 3, "./b", True), (1, 1, "../a", True), (1, 1, "models", False)],
        "review_id long, file_id long, source string, is_relative boolean",
    )
    got = {r.source: r.target for r in graph.resolve_imports(imports, files).collect()}
    assert got == {".models": "models.py", "../a": "a.ts"}


def model_batches(files, budget):
    """Largest first into the first batch with room; oversized files as chunks."""
    bins = []
    for file, tokens, chunks in sorted(files, key=lambda f: (-f[1], f[0])):
        if tokens > budget:
            bins += [[t, [(file, k)]] for k, t in enumerate(chunks)]
            continue
        for b in bins:
            if b[0] + tokens <= budget:
                b[0] += tokens
                b[1].append((file, None))
                break
        else:
            bins.append([tokens, [(file, None)]])
    return {item: i for i, b in enumerate(bins) for item in b[1]}


def test_packing_matches_model(spark):
    rng = random.Random(11)
    budget, rows, pieces, want = 20, [], [], {}
    for component in range(60):
        files = []
        for n in range(rng.randint(3, 40)):
            file = component * 100 + n
            tokens = rng.choice([0, 1, 2, 3, 5, 7, 7, 7, 11, 20, 21, 50])
            chunks = [rng.randint(1, 22) for _ in range(3)] if tokens > budget else []
            files.append((file, tokens, chunks))
            rows.append((1, component, file, file, tokens))
            pieces += [(1, component, file, file, tokens, k, t) for k, t in enumerate(chunks)]
        want.update(model_batches(files, budget))
    df = spark.createDataFrame(rows, "review_id long, component_id long, file_id long, file_ord long, tokens int")
    cut = spark.createDataFrame(pieces, "review_id long, component_id long, file_id long, file_ord long, tokens int, chunk_ord long, chunk_tokens long")
    got = {(r.file_id, r.chunk_ord): r.batch_ord for r in batching.pack_components(df, cut, budget).collect()}
    assert got == want


def test_batches(spark):
    rows = [(1, i, i, i, 250, "x" * 1000) for i in range(3)]
    schema = "review_id long, component_id long, file_id long, file_ord long, tokens int, content string"
    batches = batching.create_batches(spark.createDataFrame(rows, schema))
    assert batches.select("component_id", "batch_ord").distinct().count() == 3
    linked = [(1, 0, i, i, 5000, "x" * 20000) for i in range(3)]
    stats = batching.batch_stats(batching.create_batches(spark.createDataFrame(linked, schema), 6000)).collect()
    assert len(stats) > 1 and all(s.tokens <= 6000 for s in stats)
    long_file = "\n".join("const x = 1; // filler filler" for _ in range(2000))
    one = spark.createDataFrame([(1, 0, 0, 0, len(long_file) // 4 + 1, long_file)], schema)
    chunks = batching.chunk_large_files(one, 5000).orderBy("chunk_ord").collect()
    assert len(chunks) > 1 and "\n".join(c.content for c in chunks) == long_file


GOOD = '{"filename":"a.ts","lineStart":1,"lineEnd":2,"severity":"info","category":"style","message":"m","confidence":0.5%s}'


@pytest.mark.parametrize(
    "raw,want",
    [
        ("[" + GOOD % "" + "]", "accepted"), ("[]", "accepted"), ("```json\n[]\n```", "accepted"),
        ("[" + GOOD % ',"suggestedFix":null' + "]", "accepted"), ("nope", "not json"),
        ("[" + (GOOD % "").replace('"lineStart":1,', "") + "]", "rejected"),
        ("[" + (GOOD % "").replace('"info"', '"high"') + "]", "rejected"),
        ("[" + (GOOD % "").replace('"lineEnd":2', '"lineEnd":"2"') + "]", "rejected"),
        ("[" + (GOOD % "").replace('"lineEnd":2', '"lineEnd":2.5') + "]", "rejected"),
        ("[" + (GOOD % "").replace('"lineEnd":2', '"lineEnd":2.0') + "]", "accepted"),
        ("[" + (GOOD % "").replace("0.5", "1.5") + "]", "rejected"),
        ("[" + GOOD % "" + "," + (GOOD % "").replace('"message":"m"', '"message":3') + "]", "rejected"),
        (GOOD % "", "rejected"), ("[3]", "rejected"),
    ],
)
def test_responses(spark, raw, want):
    df = spark.createDataFrame([(1, raw)], "id int, raw string")
    assert responses.status(df).first().status == want


def test_quality(spark):
    schema = "review_id long, file_id long, category string, line_start int"
    bugs = spark.createDataFrame([(1, 1, "security", 10), (1, 1, "logic", 50), (1, 2, "logic", 1)], schema)
    found = spark.createDataFrame(
        [(1, 1, "security", 15, "critical"), (1, 1, "security", 16, "warning"), (1, 1, "style", 50, "info"),
         (1, 3, "logic", 1, "critical")],
        schema + ", severity string",
    )
    row = quality.precision_recall(bugs, found).first()
    assert (row.true_positives, row.false_negatives, row.false_positives) == (1, 2, 1)
    assert (row.planted, row.generated, row.precision) == (3, 4, 0.5)
    none = quality.precision_recall(bugs.limit(0), found.limit(0)).first()
    assert (none.precision, none.recall) == (0.0, 0.0)


FILES = "review_id long, file_id long, filename string, language string, content string"


def test_fix_status(spark):
    content = "const a = 1\nconst r = eval(x)\nconst b = 2\n"
    files = spark.createDataFrame([(1, 1, "f1.ts", "typescript", content)], FILES)
    rows = [
        finding(2, "llm", 0, fix="const r = JSON.parse(x)"),
        finding(2, "llm", 1, fix='const password = "hunter2hunter2"'),
        finding(2, "llm", 2),
        finding(2, "llm", 3, fix="if (a) {"),
        finding(1, "llm", 4, fix="let a\nlet c"),  # moves the old eval to another line
        finding(1, "llm", 5, fix="let a", file=9),
    ]
    got = fixes.fix_status(spark.createDataFrame(rows, FINDING), files)
    assert {r.ord: r.fix_status for r in got.collect()} == {
        0: "verified", 1: "unavailable", 2: "unavailable", 3: "unavailable", 4: "unavailable", 5: "unverified"
    }


def test_structure(spark):
    script = "\n".join([
        "import a from './a'", "import b from './a'", "export class Box {", "  open(x, y: any) {",
        "    if (x) {", "      return 1", "    } else {", "      return 2", "    }", "  }", "}",
        "const f = (a) => a", "export function last() { return 1 }",
    ])
    python = "\n".join(["from .m import x", "class A:", "    def go(self, b):", "        if b:", "            return 1", "",
                        "    def stop(self):", "        pass", "def _h():", "    pass", "import os, sys as s"])
    files = spark.createDataFrame([(1, 1, "a.ts", "typescript", script), (1, 2, "b.py", "python", python)], FILES)
    spans = {(r.file_id, r.name): (r.line_start, r.line_end, r.complexity) for r in structure.functions(files).collect()}
    assert spans == {
        (1, "open"): (4, 10, 3), (1, "f"): (12, 12, 1), (1, "last"): (13, 13, 1),
        (2, "go"): (3, 5, 2), (2, "stop"): (7, 8, 1), (2, "_h"): (9, 10, 1),
    }
    classes = {r.name: (r.methods, r.line_end) for r in structure.classes(files).collect()}
    assert classes == {"Box": (["open"], 11), "A": (["go", "stop"], 8)}
    imports = [(r.file_id, r.source, r.is_relative) for r in structure.imports(files).orderBy("file_id", "line_no").collect()]
    assert imports == [(1, "./a", True), (1, "./a", True), (2, ".m", True), (2, "os", False)]
    assert {r.name for r in structure.exports(files).collect()} == {"Box", "last", "A"}
    double = lint.duplicate_imports(structure.imports(files)).collect()
    assert [(r.line_start, r.severity) for r in double] == [(2, "critical")]


@pytest.mark.parametrize("ext", sorted(code_corpus.SOURCES))
def test_shapes_of_known_sources(ext):
    def filled(value):
        return value.replace("<ID>", "77").replace("<NEXT>", "88")

    source = filled(code_corpus.SOURCES[ext]).replace(code_corpus.DOC, "Text with 'quotes, if (a) { and for")
    language = dict(ts="typescript", js="javascript", py="python", rs="rust", rb="ruby").get(ext, ext)
    shape = code_shape.Shape(source, language)
    found = shape.functions()
    assert [(f["name"], f["line_start"], f["line_end"], f["complexity"], f["params"]) for f in found] == [
        (filled(f[0]), *f[1:]) for f in code_corpus.FUNCTIONS[ext]
    ]
    assert [(c["name"], c["line_start"], c["line_end"], c["methods"]) for c in shape.classes(found)] == [
        (filled(c[0]), c[1], c[2], [filled(m) for m in c[3]]) for c in code_corpus.CLASSES.get(ext, [])
    ]
    assert [(shape.line(at), s) for at, s in shape.imports()] == [
        (i[0], filled(i[2])) for i in code_corpus.IMPORTS.get(ext, [])
    ]
    assert shape.deep_lines(found, 4) == code_corpus.DEEP.get(ext, [])


@pytest.mark.parametrize("language", ["typescript", "python", "java", "go", "rust", "c", "cpp", "ruby", "php"])
def test_shapes_of_broken_sources(language):
    for source in ("", "}", "((({", "def f(", "fn x(", "class", "func (", "=>", "import (", '"', "function f(a, b", "a\n" * 50):
        shape = code_shape.Shape(source, language)
        found = shape.functions()
        shape.classes(found), shape.imports(), shape.deep_lines(found, 4)


def test_reuse(spark):
    files = spark.createDataFrame(
        [(1, 1, "a.ts", "eval(x)", "h1"), (1, 2, "b.py", "eval(x)", "h1"), (1, 3, "c.ts", "ok", "h2")],
        "review_id long, file_id long, filename string, content string, content_hash string",
    )
    found = reuse.scan_distinct(files)
    assert sorted((r.file_id, r.rule_id) for r in found.collect()) == [(1, "dangerous-eval"), (2, "dangerous-eval")]
    heads = spark.createDataFrame([("h1", reuse.rule_version(), 1)], "content_hash string, rule_version string, seq long")
    assert sorted(r.file_id for r in reuse.known(files, heads).collect()) == [1, 2]
    assert [r.file_id for r in reuse.unknown(files, heads).collect()] == [3]
    assert reuse.known(files, heads, version="other").count() == 0


def test_registry_survives_a_failing_analyzer(spark):
    files = spark.createDataFrame([(1, 1, "a.ts", "typescript", "console.log(1)")], FILES)

    def at_planning(_):
        raise RuntimeError("no")

    def at_run_time(df):
        return scan.scan(df).withColumn("rule_id", F.raise_error(F.lit("boom")).cast("string"))

    registry = plugins.default_registry()
    registry.register(plugins.Analyzer("planning", at_planning)).register(plugins.Analyzer("running", at_run_time))
    got = registry.analyze(files, isolated=True)
    assert sorted(r.rule_id for r in got.collect()) == ["console-log", "no-console"]


def test_scorer_falls_back_to_canned(spark):
    files = spark.createDataFrame([(1, 1, "a.ts", "x")], "review_id long, file_id long, filename string, content string")
    canned = spark.createDataFrame(
        [("a.ts", "logic", "info", "m", 1, 1, None, 0.5, 0)],
        "filename string, category string, severity string, message string, line_start int, line_end int, "
        "suggested_fix string, confidence double, position long",
    )
    assert [r.source for r in plugins.score_batches(files, "nobody", canned).collect()] == ["llm"]
    with pytest.raises(ValueError):
        plugins.score_batches(files, "nobody", canned, profile="odd")


def test_batch_metrics_come_from_the_calls(spark):
    import time

    import pandas as pd

    files = spark.createDataFrame(
        [(1, n % 3, n, f"f{n}.ts", "x" * n) for n in range(1, 10)], "review_id long, batch int, file_id long, filename string, content string"
    )
    columns = ["review_id", "file_id", "filename", "category", "severity", "message", "line_start", "line_end", "suggested_fix", "confidence"]

    def slow(frame, profile):
        time.sleep(0.02)
        return pd.DataFrame(
            [(r.review_id, r.file_id, r.filename, "c", "info", profile, 1, 1, None, None) for r in frame.itertuples() if r.file_id > 4], columns=columns
        )

    plugins.SCORERS["slow-test"] = slow
    canned = spark.createDataFrame([], "filename string, source string, category string, severity string, message string, "
                                   "line_start int, line_end int, suggested_fix string, confidence double, position long")
    try:
        found, told = plugins.score_with_metrics(files, "slow-test", canned, "quality", ("review_id", "batch"))
        rows = {r.batch: r for r in told.collect()}
    finally:
        del plugins.SCORERS["slow-test"]
    assert sorted(r.file_id for r in found.collect()) == [5, 6, 7, 8, 9] and "_tokens" not in found.columns
    assert {b: (r.files, r.tokens, r.findings) for b, r in rows.items()} == {0: (3, 1 + 2 + 3, 2), 1: (3, 1 + 1 + 2, 1), 2: (3, 1 + 2 + 2, 2)}
    assert all(r.millis >= 20 for r in rows.values())
    _, idle = plugins.score_with_metrics(files, "nobody", canned)
    assert [(r.files, r.findings, r.millis) for r in idle.collect()] == [(9, 0, None)]
