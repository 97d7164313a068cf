"""Checks of fixes next to a plain rebuild of each file."""

import random

import pytest

from linewright.operators import fixes, lint, structure
from linewright.operators.shifts import Shifted
from tests.test_operators import FINDING

FILES = "review_id long, file_id long, filename string, language string, content string"


@pytest.mark.parametrize("step, n", [(1, 200), (3, 200), (7, 60), (1, 0), (50, 400)])
def test_last_miss_equals_a_walk(step, n):
    rng = random.Random(step)
    for dense in (0.05, 0.5, 0.95):
        lines = [x for x in range(1, n + 1) if x % step == 0 or rng.random() < dense]
        held, both = set(lines), Shifted(lines)
        for distance in range(1, n + 3):
            for floor in (0, n // 2, n):
                want = max((x for x in lines if x > floor and x - distance not in held), default=None)
                assert both.last_miss(distance, floor) == want


def test_distances_of_a_period_are_searched_not_walked(monkeypatch):
    lines = list(range(10, 200_001, 10))
    both, asked = Shifted(lines), 0
    inner = Shifted._sum

    def counted(self, *where):
        nonlocal asked
        asked += 1
        return inner(self, *where)

    monkeypatch.setattr(Shifted, "_sum", counted)
    for distance in (10, 5000, 99_990):
        assert both.last_miss(distance, 0) == distance
    assert asked < 3 * 2 * 25


def spliced(content, start, end, fix):
    lines = content.split("\n")
    return "\n".join(lines[: max(0, start - 1)] + fix.split("\n") + lines[min(len(lines), end) :])


def evals(content):
    return {n for n, line in enumerate(content.split("\n")) if "eval(" in line}


def repeated(content):
    seen, out = set(), set()
    for n, line in enumerate(content.split("\n")):
        if line.startswith("import "):
            module = line.split('"')[1]
            if module in seen:
                out.add(n)
            seen.add(module)
    return out


def case(spark, rng, lines, n_files=12, n_findings=40):
    files, rows = [], []
    for f in range(n_files):
        content = "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 8, 30])))
        files.append((f % 3, f, f"f{f}.ts", "typescript", content))
        for n in range(n_findings):
            start = rng.randrange(1, 34)
            fix = "\n".join(rng.choice(lines) for _ in range(rng.choice([1, 1, 2, 3, 6])))
            rows.append((f % 3, f, f"f{f}.ts", "llm", "logic", "info", "m", start, start + rng.choice([0, 0, 1, 3, 12]), None, fix, None, n))
    return files, rows, spark.createDataFrame(rows, FINDING), spark.createDataFrame(files, FILES)


@pytest.mark.parametrize("check, lines, hits", [
    (fixes.pattern_check, ["r = eval(x)", "k = 1", "k = 2"], evals),
    (fixes.pattern_check, ["r = eval(x)", "r = eval(y)", "k = 1"], evals),
    (fixes.lint_check, ['import a from "m1"', 'import b from "m2"', 'import c from "m3"', "let k", "let j", "let i"], repeated),
    (fixes.lint_check, ['import a from "m1"', 'import b from "m2"', "let k"], repeated),
    (fixes.lint_check, ['import a from "m1"'] + ["let k"] * 5, repeated),
])
def test_regressions_equal_a_rebuild(spark, check, lines, hits):
    files, rows, findings, table = case(spark, random.Random(len(lines)), lines)
    contents = {(f[0], f[1]): f[4] for f in files}
    got = {(r.file_id, r.ord): r.regressed for r in check(findings, table).collect()}
    want = {
        (r[1], r[12]): bool(hits(spliced(contents[r[0], r[1]], r[7], r[8], r[10])) - hits(contents[r[0], r[1]])) for r in rows
    }
    assert got == want and 0.1 < sum(want.values()) / len(want) < 0.95


def test_a_fix_that_repeats_an_import_is_unavailable(spark):
    files = spark.createDataFrame([(1, 1, "f1.ts", "typescript", 'import a from "m"\nlet k\nlet j')], FILES)
    base = (1, 1, "f1.ts", "llm", "logic", "info", "m")
    rows = [(*base, 2, 2, None, 'import b from "m"', None, 0), (*base, 2, 2, None, 'import b from "n"', None, 1),
            (*base, 1, 1, None, 'import b from "m"', None, 2), (*base, 1, 1, None, 'import b from "n"; import c from "n"', None, 3)]
    got = fixes.fix_status(spark.createDataFrame(rows, FINDING), files)
    assert {r.ord: r.fix_status for r in got.collect()} == {0: "unavailable", 1: "verified", 2: "verified", 3: "unavailable"}


def test_two_imports_on_one_line_are_a_repeat(spark):
    files = spark.createDataFrame([(1, 1, "f1.ts", "typescript", 'import a from "m"; import b from "m"\nlet k')], FILES)
    found = lint.duplicate_imports(structure.imports(files)).collect()
    assert [(r.line_start, r.rule_id) for r in found] == [(1, "no-duplicate-imports")]
