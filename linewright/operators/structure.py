"""Functions, classes, imports and exports of source files.

The task that reads a file finds its headers, blocks and imports (``code_shape``): a file is
one cell to begin with, so no line of it is shuffled and nothing is sorted. Approximate by
design where only a parser could know: text inside template strings is text, generic
arguments are told from comparisons by what follows, and a function type may look like an
arrow function. Exports are found line by line with column functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns, text
from linewright.operators.code_shape import SCRIPT, Shape

FILE = ["review_id", "file_id"]

_FACTS = (
    "review_id long, file_id long, filename string, language string, kind string, part int, name string, "
    "line_start int, line_end int, complexity int, params array<string>, methods array<string>"
)
_FACT_TYPES = pa.schema(
    [("review_id", pa.int64()), ("file_id", pa.int64()), ("filename", pa.string()), ("language", pa.string()),
     ("kind", pa.string()), ("part", pa.int32()), ("name", pa.string()), ("line_start", pa.int32()),
     ("line_end", pa.int32()), ("complexity", pa.int32()), ("params", pa.list_(pa.string())),
     ("methods", pa.list_(pa.string()))]
)

#: Rows that a task gathers before it hands them on.
_ROWS = 1024

# Export headers; group 1 is the name.
EXPORT_HEADERS = {
    "script": r"^\s*export\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum)\s+(\w+)",
    "python": r"^(?:async\s+)?(?:def|class)\s+([A-Za-z0-9]\w*)",
    "java_class": r"\bpublic\s+(?:\w+\s+)*class\s+(\w+)",
    "java_method": r"^\s*public\s[^=;(]*?(\w+)\s*\([^)]*\)[^;]*\{",
    "go": r"^func\s+([A-Z]\w*)\s*\(",
}


def _char_count(line: Column, char: str) -> Column:
    without = F.replace(line, F.lit(char), F.lit(""))
    return F.when(line.contains(char), F.length(line) - F.length(without)).otherwise(0)


def _rows(shape: Shape, wanted: frozenset[str], deepest: int) -> Iterator[dict]:
    functions = shape.functions() if wanted & {"function", "class", "deep"} else []
    if "function" in wanted:
        for part, f in enumerate(functions):
            yield {"kind": "function", "part": part, **{k: f[k] for k in ("name", "line_start", "line_end", "complexity", "params")}}
    if "class" in wanted:
        for part, c in enumerate(shape.classes(functions)):
            yield {"kind": "class", "part": part, **{k: c[k] for k in ("name", "line_start", "line_end", "methods")}}
    if wanted & {"import", "repeat"}:
        last, part, known = 0, 0, set()
        for at, source in shape.imports():
            line = shape.line(at)
            part = part + 1 if line == last else 0
            last = line
            if "import" in wanted:
                yield {"kind": "import", "part": part, "name": source, "line_start": line}
            if "repeat" in wanted and source in known:
                yield {"kind": "repeat", "part": part, "name": source, "line_start": line, "line_end": line}
            known.add(source)
    if "deep" in wanted:
        for line in shape.deep_lines(functions, deepest):
            yield {"kind": "deep", "part": 0, "line_start": line, "line_end": line}


def _found(batches: Iterator[pa.RecordBatch], wanted: frozenset[str], deepest: int) -> Iterator[pa.RecordBatch]:
    """Facts of the files of Arrow batches, a few rows at a time."""
    out = []
    for batch in batches:
        for at in range(batch.num_rows):
            *key, content = (column[at].as_py() for column in batch.columns)
            names = dict(zip(("review_id", "file_id", "filename", "language"), key))
            for row in _rows(Shape(content, key[3]), wanted, deepest):
                out.append(names | row)
                if len(out) == _ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema=_FACT_TYPES)
                    out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_FACT_TYPES)


def facts(files: DataFrame, *kinds: str, deepest: int = 4) -> DataFrame:
    """Rows of the wanted kinds (function, class, import, deep, repeat), found where a file is read.

    A ``repeat`` is an import of a module that the file imported before. One content at a time is in
    Python next to the Arrow batch it came in.
    """
    wanted = frozenset(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _found(batches, wanted, deepest)

    known = files.where(F.col("language").isin(*fv.PARSED_LANGUAGES) & (F.col("content") != ""))
    return known.select(
        F.col("review_id").cast("long"), F.col("file_id").cast("long"), "filename", "language", "content"
    ).mapInArrow(run, _FACTS)


def _of_kind(kind: str, files: DataFrame, found: DataFrame | None) -> DataFrame:
    """Rows of one kind, from ``found`` where the facts of the files are known already."""
    return facts(files, kind) if found is None else found.where(F.col("kind") == kind)


def functions(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Functions with span and complexity; nested functions count into outer ones.

    ``part`` is the place of a function in its file, outer ones first.
    """
    return _of_kind("function", files, found).select(*FILE, "filename", "language", "name", "line_start", "line_end", "complexity", "part", "params")


def classes(files: DataFrame) -> DataFrame:
    """Classes with span and the names of the functions directly in their body.

    An implementation block has the name of the type it is for.
    """
    return facts(files, "class").select(*FILE, "filename", "language", "name", "line_start", "line_end", "methods")


def parameters(files: DataFrame) -> DataFrame:
    """One row per parameter of a function header."""
    return facts(files, "function").select(
        *FILE, F.col("line_start").alias("line_no"), "part", F.col("name").alias("function"),
        F.posexplode("params").alias("position", "param"),
    )


def imports(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Import rows ``(.., language, line_no, part, source, is_relative)``.

    A statement may take several lines, and a line may hold several; ``part`` tells
    those of one line apart. ``line_no`` is where the statement, or in a block of imports its
    own path, begins.
    """
    source, language = F.col("source"), F.col("language")
    relative = (
        F.when(language.isin(*SCRIPT, "python"), source.startswith("."))
        .when(language == "go", source.startswith(".") | source.startswith("/"))
        .when(language == "rust", source.startswith("self::") | source.startswith("super::"))
        .otherwise(False)
    )
    return _of_kind("import", files, found).select(
        *FILE, "filename", "language", F.col("line_start").alias("line_no"), "part", F.col("name").alias("source")
    ).withColumn("is_relative", relative)


def deep_lines(files: DataFrame, deepest: int) -> DataFrame:
    """Lines that open a block nested more than ``deepest`` deep in their function."""
    return facts(files, "deep", deepest=deepest).select(*FILE, "filename", "language", "line_start", "line_end")


def exports(files: DataFrame) -> DataFrame:
    """Names a file offers, one row per name; no shuffle."""
    language, line = F.col("language"), F.col("line")
    lines = files.where(language.isin(*fv.SCRIPT_LANGUAGES, "python", "java", "go")).select(
        *FILE, "filename", "language",
        F.posexplode(text.split_lines(F.col("content"))).alias("pos", "line"),
    )

    def group(name: str) -> Column:
        found = F.regexp_extract(line, patterns.jvm(EXPORT_HEADERS[name]), 1)
        return F.when(found != "", found)

    name = (
        F.when(language.isin(*fv.SCRIPT_LANGUAGES) & line.contains("export"), group("script"))
        .when((language == "python") & (line.contains("def") | line.contains("class")), group("python"))
        .when(
            (language == "java") & line.contains("public"),
            F.coalesce(group("java_class"), group("java_method")),
        )
        .when((language == "go") & line.startswith("func"), group("go"))
    )
    return lines.select(
        *FILE, "filename", (F.col("pos") + 1).alias("line_no"), name.alias("name")
    ).where("name IS NOT NULL")


def file_complexity(files: DataFrame) -> DataFrame:
    """Sum over functions, 1 where there are none; null where no grammar is known."""
    sums = functions(files).groupBy(*FILE).agg(F.sum("complexity").alias("total"))
    parsed = F.col("language").isin(*fv.PARSED_LANGUAGES)
    return files.drop("content").join(sums, FILE, "left").withColumn(
        "complexity", F.when(parsed, F.coalesce(F.nullif("total", F.lit(0)), F.lit(1))).cast("long")
    ).drop("total")


def bracket_imbalance(content: Column) -> Column:
    """How far the three kinds of brackets are from being balanced."""
    total = F.lit(0)
    for opening, closing in ("()", "[]", "{}"):
        total = total + F.abs(_char_count(content, opening) - _char_count(content, closing))
    return total
