"""Scalar functions, ingestion filters and input checks on small cases."""

import pytest
from pyspark.sql import functions as F

from linewright.functions import patterns, text
from linewright.operators import scan, validation
from linewright.sources import ingest
from linewright.sources.corpus import TEMPLATE_LINES

TEMPLATE_RULES = {
    0: ["hardcoded-aws-key"], 1: ["hardcoded-generic-secret"], 2: ["hardcoded-private-key"],
    3: ["hardcoded-jwt-secret"], 4: ["sql-string-concat"], 5: ["dangerous-eval"],
    6: ["dangerous-deserialize"], 7: ["dangerous-deserialize"], 9: ["innerHTML-xss"],
    10: ["shell-injection"], 11: ["todo-fixme"], 12: ["console-log"], 13: ["magic-number"],
    14: ["magic-number"], 16: ["commented-out-code"], 18: ["commented-out-code"],
    19: ["empty-catch"], 20: ["hardcoded-ip"], 21: ["hardcoded-url"], 23: ["dangerous-eval"],
}


def evaluate(spark, values, expression, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_token_estimate(spark):
    got = evaluate(spark, ["", None, "x" * 100, "x" * 10, "y" * 36, "😀" * 3], text.token_estimate(F.col("v")))
    assert got == [0, 0, 25, 3, 9, 2]


def test_sanitize_is_one_pass_per_step(spark):
    got = evaluate(
        spark, ["../../a.ts", "....//a", "..\\a", "a\x00\x01b", "n" * 300], text.sanitize_filename(F.col("v"))
    )
    assert got == ["a.ts", "../a", "a", "ab", "n" * 255]


def test_language_and_fence(spark):
    names = ["a.TS", "x.tsx", "Dockerfile", "b.yml", "c.xyz", "d.h"]
    assert evaluate(spark, names, text.detect_language(F.col("v"))) == [
        "typescript", "tsx", "docker", "yaml", "unknown", "c"
    ]
    assert evaluate(spark, names, text.fence_language(F.col("v"))) == [
        "typescript", "typescript", "dockerfile", "yml", "xyz", "h"
    ]


def test_lines_of_code(spark):
    contents = ["", "a\n\n  // c\n\t# d\n/* e\n * f\n b", " \n x\r\n", "//\n\n\n", "a"]
    assert evaluate(spark, contents, text.lines_of_code(F.col("v"))) == [0, 2, 1, 0, 1]


def test_binary_probe_stops_after_8192(spark):
    contents = ["a\x00b", "a" * 8192 + "\x00", "a" * 8191 + "\x00"]
    assert evaluate(spark, contents, text.is_binary(F.col("v"))) == [True, False, True]


@pytest.mark.parametrize("start,end,want", [(10, 10, "8 9 10 11 12"), (1, 1, "1 2 3"), (20, 20, "18 19 20")])
def test_snippet(spark, start, end, want):
    content = "\n".join(str(i) for i in range(1, 21))
    got = evaluate(
        spark, [content], text.code_snippet(text.split_lines(F.col("v")), F.lit(start), F.lit(end))
    )
    assert got == [want.replace(" ", "\n")]


def test_repo_urls(spark):
    urls = [
        " https://github.com/a/b/ ", "https://github.com/a/b.git", "https://github.com/a/b/pull/7",
        "https://github.com/a/b/blob/main/src/x.ts", "https://github.com/a/b/blob/main",
        "https://github.com/a/b/tree/dev", "https://example.com/a/b",
    ]
    got = evaluate(spark, urls, text.parse_repo_url(F.col("v")))
    assert [(r.type, r.ref, r.path, r.pr_number) for r in got] == [
        ("repo", "main", None, None), ("repo", "main", None, None), ("pr", None, None, 7),
        ("file", "main", "src/x.ts", None), ("repo", "main", None, None), ("tree", "dev", "", None),
        (None, None, None, None),
    ]


def test_template_lines(spark):
    rows = spark.createDataFrame(list(enumerate(TEMPLATE_LINES)), "i int, line string")
    names = list(scan.RULE_ORDER)
    got = {r.i: [names[n] for n in r.hits] for r in rows.select("i", scan.rule_numbers(F.col("line")).alias("hits")).collect()}
    assert {i: h for i, h in got.items() if h} == TEMPLATE_RULES


def test_literal_checks_lose_no_hit(spark):
    """The literals looked for first must never hide what the regex alone would find."""
    tails = ["", " 300", "$", "{}", "'", "\"10.1.2.3\"", "// TODO", "%S", ".FORMAT(", "é"]
    lines = [t + tail for t in TEMPLATE_LINES for tail in tails] + [
        "select a .FORMAT(b)", "Delete x F'", "insert + USER", "éeval(x)", "for 1000", "if 12345",
        "catch\n{}", "TOKEN: 'abcdefgh1'", "v-html =", "x.innerHTML = y", "'0.0.0.0'",
    ]
    rows = spark.createDataFrame([(line,) for line in lines], "line string")
    for name, pattern, ignore_case, *_ in scan.fv.LINE_RULES:
        plain = F.col("line").rlike(patterns.jvm(pattern, ignore_case))
        wrong = rows.where(plain != scan.rule_match(F.col("line"), name)).collect()
        assert not wrong, (name, wrong)


def test_boundaries_are_ascii(spark):
    rows = spark.createDataFrame([("éeval(x)",), ("xeval(x)",)], "line string")
    assert [r[0] for r in rows.select(scan.rule_match(F.col("line"), "dangerous-eval")).collect()] == [True, False]


def test_validation(spark):
    files = spark.createDataFrame(
        [(1, i, f"f{i}.ts", "x") for i in range(101)]
        + [(2, 0, "a.exe", "x"), (2, 1, "Dockerfile", "é" * 10)]
        + [(3, i, f"g{i}.py", "z" * 600000) for i in range(3)],
        "review_id long, file_ord long, filename string, content string",
    )
    errors = validation.validate(files, max_file_mb=0.5, max_total_mb=1.5)
    got = [tuple(r) for r in errors.orderBy("review_id", "ord", "check_ord").select("review_id", "field", "message").collect()]
    assert got == [
        (1, "files", "Too many files. Maximum is 100."),
        (2, "a.exe", "File extension .exe is not allowed."),
        (3, "g0.py", "File exceeds 0.5MB limit."),
        (3, "g1.py", "File exceeds 0.5MB limit."),
        (3, "g2.py", "File exceeds 0.5MB limit."),
        (3, "files", "Total upload size exceeds 1.5MB limit."),
    ]
    assert validation.accepted(files, errors).count() == 0


def test_manifest_keeps_fifty(spark):
    rows = [(1, i, f"src/a{i}.ts", "blob", None) for i in range(60)]
    rows += [(1, 100, ".hid/a.ts", "blob", 1), (1, 101, "b/.x/a.ts", "blob", 1), (1, 102, "a.ts", "blob", 524289)]
    manifest = spark.createDataFrame(rows, "repo_id int, listing_ord int, path string, type string, size long")
    assert [r.listing_ord for r in ingest.filter_manifest(manifest).orderBy("listing_ord").collect()] == list(range(50))


def test_read_text_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "b.ts").write_text("let a\n")
    files = ingest.read_text_files(spark, str(tmp_path), base=tmp_path.name)
    assert {r.filename: r.content for r in files.collect()} == {"src/a.py": "x = 1\ny = 2\n", "b.ts": "let a\n"}


def test_write_and_read_by_review(spark, tmp_path):
    df = spark.range(100).selectExpr("id % 7 AS review_id", "id AS n")
    ingest.write_by_review(df, str(tmp_path / "t"))
    assert ingest.read_by_review(spark, str(tmp_path / "t")).count() == 100
    one = ingest.read_by_review(spark, str(tmp_path / "t"), review_id=3)
    assert sorted(r.n for r in one.collect()) == list(range(3, 100, 7))
