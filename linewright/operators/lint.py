"""Lint rules restated over lines, spans and groups of script files.

These are textual approximations: no parser runs, so strings and comments that span
lines, and braces inside them, count as code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text
from linewright.operators import scan, structure

STRIP_STRINGS = "\"[^\"]*\"|'[^']*'|`[^`]*`"
STRIP_COMMENT = "//.*$"

# (rule, level, pattern, on stripped line, TypeScript only, text), in rule order.
LINT_LINE_RULES = (
    ("no-eval", "error", r"\beval\s*\(", True, False, "eval can be harmful."),
    ("no-implied-eval", "error",
     r"\b(?:setTimeout|setInterval|execScript)\s*\(\s*['\"`]", False, False,
     "Implied eval. Consider passing a function instead of a string."),
    ("no-console", "warn", r"\bconsole\.\w+\s*\(", True, False, "Unexpected console statement."),
    ("eqeqeq", "error", r"(?:^|[^=!<>])(?:==|!=)(?:[^=]|$)", True, False,
     "Expected '===' or '!=='."),
    ("no-var", "error", r"(?:^|[;({]|\bexport\s)\s*var\s", True, False,
     "Unexpected var, use let or const instead."),
    ("no-throw-literal", "error",
     r"\bthrow\s+(?:['\"`0-9]|true\b|false\b|null\b)", False, False,
     "Expected an error object to be thrown."),
    ("@typescript-eslint/no-explicit-any", "warn",
     r":\s*any\b|\bas\s+any\b|<any>", True, True,
     "Unexpected any. Specify a different type."),
)

# (rule, level, text) of the rules that look at spans, blocks or groups.
LINT_SPAN_RULES = {
    "no-duplicate-imports": ("error", "import is duplicated."),
    "max-lines-per-function": ("warn", "Function has too many lines. Maximum allowed is 50."),
    "max-depth": ("warn", "Blocks are nested too deeply. Maximum allowed is 4."),
    "complexity": ("warn", "Function has too high a complexity. Maximum allowed is 10."),
}

# One literal out of each tuple must be in the line before a rule's regex is tried.
_NEEDS = {
    "no-eval": (("eval",),),
    "no-implied-eval": (("setTimeout", "setInterval", "execScript"),),
    "no-console": (("console.",),),
    "eqeqeq": (("==", "!="),),
    "no-var": (("var",),),
    "no-throw-literal": (("throw",),),
    "@typescript-eslint/no-explicit-any": (("any",),),
}


def stripped(line: Column) -> Column:
    """A line without string contents and without its line comment.

    Lines without any literal of a rule are given back as they are; no rule looks at them.
    """
    return F.when(_any_need(line), _without_strings(line)).otherwise(line)


def _without_strings(line: Column) -> Column:
    return F.regexp_replace(
        F.regexp_replace(line, STRIP_STRINGS, '""'), patterns.jvm(STRIP_COMMENT), ""
    )


def severity(level: str) -> str:
    return fv.LINT_LEVEL.get(level, "warning")


def category(rule: str) -> str:
    return fv.LINT_CATEGORY.get(rule, fv.LINT_DEFAULT_CATEGORY)


def is_linted(language: Column) -> Column:
    return language.isin(*fv.LINT_LANGUAGES)


def rule_numbers(line: Column, bare: Column, language: Column, level: str | None = None) -> Column:
    """Positions of the line rules that fire; ``bare`` is the stripped line."""
    hits = []
    for position, (rule, rule_level, pattern, on_bare, typed_only, _) in enumerate(LINT_LINE_RULES):
        if level is not None and rule_level != level:
            continue
        subject = bare if on_bare else line
        fires = scan.has_literals(line, _NEEDS[rule]) & subject.rlike(patterns.jvm(pattern))
        if typed_only:
            fires = fires & (language != "javascript")
        hits.append(F.when(fires, F.lit(position)))
    return F.array_compact(F.array(*hits))


def _any_need(line: Column) -> Column:
    chance = F.lit(False)
    for needs in _NEEDS.values():
        chance = chance | scan.has_literals(line, needs)
    return chance


def line_findings(files: DataFrame) -> DataFrame:
    """The seven line rules in one pass over the lines, without a shuffle."""
    lines = scan.explode_lines(
        files.where(is_linted(F.col("language"))), "review_id", "file_id", "filename", "language"
    )
    hits = (
        lines.where(_any_need(F.col("line")))
        .withColumn("bare", _without_strings(F.col("line")))
        .select(
            "review_id", "file_id", "filename", "line_no",
            F.explode(rule_numbers(F.col("line"), F.col("bare"), F.col("language"))).alias("n"),
        )
    )
    place = F.col("n") + 1

    def constant(values) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), place)

    rules = LINT_LINE_RULES
    return hits.select(
        "review_id", "file_id", "filename",
        F.lit("eslint").alias("source"),
        constant([category(r[0]) for r in rules]).alias("category"),
        constant([severity(r[1]) for r in rules]).alias("severity"),
        constant([f"{r[0]}: {r[5]}" for r in rules]).alias("message"),
        F.col("line_no").alias("line_start"),
        F.col("line_no").alias("line_end"),
        constant([r[0] for r in rules]).alias("rule_id"),
        (F.col("line_no").cast("long") * 16 + F.col("n")).alias("ord"),
    )


def _span_finding(df: DataFrame, rule: str, position: int) -> DataFrame:
    """Findings of one span rule from ``line_start`` and ``line_end``."""
    level, message = LINT_SPAN_RULES[rule]
    return df.select(
        "review_id", "file_id", "filename",
        F.lit("eslint").alias("source"),
        F.lit(category(rule)).alias("category"),
        F.lit(severity(level)).alias("severity"),
        F.lit(f"{rule}: {message}").alias("message"),
        "line_start", "line_end",
        F.lit(rule).alias("rule_id"),
        (F.col("line_start").cast("long") * 16 + position).alias("ord"),
    )


def duplicate_imports(imports: DataFrame) -> DataFrame:
    """Second and later import of one module in a file, also on the line of the first.

    The first place of each module is an aggregate with a map-side half; a window would
    sort all imports of a hot module in one task.
    """
    script = imports.where(is_linted(F.col("language")))
    keys = ["review_id", "file_id", "source"]
    place = F.struct("line_no", "part")
    first = script.groupBy(*keys).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = first.where(F.col("n") > 1)
    later = script.join(repeated, keys).where(place > F.col("first"))
    return _span_finding(
        later.withColumn("line_start", F.col("line_no")).withColumn("line_end", F.col("line_no")),
        "no-duplicate-imports", 8,
    )


def long_functions(functions: DataFrame) -> DataFrame:
    length = F.col("line_end") - F.col("line_start") + 1
    found = functions.where(is_linted(F.col("language")) & (length > fv.MAX_FUNCTION_LINES))
    return _span_finding(found, "max-lines-per-function", 9)


def complex_functions(functions: DataFrame) -> DataFrame:
    """``functions`` with their ``complexity``."""
    found = functions.where(is_linted(F.col("language")) & (F.col("complexity") > fv.MAX_COMPLEXITY))
    return _span_finding(found, "complexity", 10)


def deep_blocks(files: DataFrame) -> DataFrame:
    """Lines of a function that open a block nested more than four deep."""
    return _span_finding(
        structure.deep_lines(files.where(is_linted(F.col("language"))), fv.MAX_BLOCK_DEPTH),
        "max-depth", 11,
    )


def span_findings(files: DataFrame) -> DataFrame:
    """The rules on functions, blocks and repeated imports in one pass over the texts, without a shuffle."""
    linted = files.where(is_linted(F.col("language")))
    found = structure.facts(linted, "function", "deep", "repeat", deepest=fv.MAX_BLOCK_DEPTH)
    function = F.col("kind") == "function"
    long = function & (F.col("line_end") - F.col("line_start") + 1 > fv.MAX_FUNCTION_LINES)
    fired = {
        "no-duplicate-imports": (8, F.col("kind") == "repeat"),
        "max-lines-per-function": (9, long),
        "complexity": (10, function & (F.col("complexity") > fv.MAX_COMPLEXITY)),
        "max-depth": (11, F.col("kind") == "deep"),
    }
    marks = []
    for rule, (position, fires) in fired.items():
        level, message = LINT_SPAN_RULES[rule]
        marks.append(
            F.when(
                fires,
                F.struct(
                    F.lit(rule).alias("rule_id"), F.lit(category(rule)).alias("category"),
                    F.lit(severity(level)).alias("severity"), F.lit(f"{rule}: {message}").alias("message"),
                    F.lit(position).alias("n"),
                ),
            )
        )
    return found.withColumn("m", F.explode(F.array_compact(F.array(*marks)))).select(
        "review_id", "file_id", "filename", F.lit("eslint").alias("source"), "m.category", "m.severity", "m.message",
        "line_start", "line_end", "m.rule_id", (F.col("line_start").cast("long") * 16 + F.col("m.n")).alias("ord"),
    )
