"""Scalar functions over text columns; all of them stay JVM-side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import patterns

NEWLINE = "\n"


def split_lines(content: Column) -> Column:
    """Lines in order; trailing empty ones are kept and a carriage return stays in its line."""
    return F.split(content, NEWLINE, -1)


def line_count(content: Column) -> Column:
    """Number of lines without building them."""
    return F.length(content) - F.length(F.replace(content, F.lit(NEWLINE), F.lit(""))) + 1


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """Value of a small fixed table; null where the key is unknown."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def one_of(column: Column, values: Sequence[str]) -> Column:
    return column.isin(*values)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit all size limits are stated in."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trim_space(text: Column) -> Column:
    edge = patterns.SPACE
    return F.regexp_replace(text, f"^{edge}+|{edge}+\\z", "")


def extension(filename: Column) -> Column:
    """Lower-case text behind the last dot; the whole name where there is no dot."""
    return F.lower(F.substring_index(filename, ".", -1))


def sanitize_filename(filename: Column, longest: int = fv.MAX_FILENAME) -> Column:
    """Each removal is one pass, so removing can leave a new climbing step behind."""
    cleaned = F.replace(filename, F.lit("../"), F.lit(""))
    cleaned = F.replace(cleaned, F.lit("..\\"), F.lit(""))
    cleaned = F.regexp_replace(cleaned, r"[\x00-\x1f]", "")
    return F.substring(cleaned, 1, longest)


def detect_language(filename: Column) -> Column:
    return F.coalesce(lookup(fv.LANGUAGE_BY_EXTENSION, extension(filename)), F.lit("unknown"))


def fence_language(filename: Column, language: Column | None = None) -> Column:
    key = extension(filename)
    guessed = F.coalesce(lookup(fv.FENCE_BY_EXTENSION, key), key)
    if language is None:
        return guessed
    return F.when(language.isNull() | (language == ""), guessed).otherwise(language)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def lines_of_code(content: Column) -> Column:
    """Lines that are neither blank nor open with a comment mark, in one regex pass."""
    code_line = rf"(?:^|\n){patterns.LINE_SPACE}*+(?!//|#|/\*|\*|\n)[^\n]"
    return F.regexp_count(content, F.lit(code_line))


def is_binary(content: Column, probe: int = fv.BINARY_PROBE_CHARS) -> Column:
    return F.contains(F.substring(content, 1, probe), F.lit("\x00"))


def token_estimate(text: Column) -> Column:
    return F.ceil(utf16_length(F.coalesce(text, F.lit(""))) / fv.CHARS_PER_TOKEN).cast("int")


def code_snippet(lines: Column, line_start: Column, line_end: Column) -> Column:
    """The lines of a finding with two lines of context on each side."""
    first = F.greatest(line_start - 3, F.lit(0))
    last = F.least(F.size(lines), line_end + 2)
    return F.array_join(F.slice(lines, first + 1, F.greatest(last - first, F.lit(0))), NEWLINE)


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "good").when(score >= 50, "ok").when(score.isNotNull(), "bad")


def rank(values: Mapping[str, int], key: Column) -> Column:
    return F.coalesce(lookup(values, key), F.lit(0))


def line_label(line_start: Column, line_end: Column) -> Column:
    """``Line a`` or ``Line a-b``."""
    tail = F.when(line_end != line_start, F.concat(F.lit("-"), line_end.cast("string")))
    return F.concat(F.lit("Line "), line_start.cast("string"), F.coalesce(tail, F.lit("")))


def decode_base64(payload: Column) -> Column:
    return F.unbase64(payload).cast("string")


def parse_repo_url(url: Column) -> Column:
    """Struct of owner, repo, type, ref, path and pr_number; type is null when nothing fits."""
    cleaned = F.regexp_replace(trim_space(url), r"/\z", "")
    pattern = patterns.jvm(fv.REPO_URL_PATTERN)
    names = ("owner", "repo", "pull", "number", "kind", "ref", "path")
    part = {n: F.regexp_extract(cleaned, pattern, i + 1) for i, n in enumerate(names)}
    known = cleaned.rlike(pattern)
    kind = (
        F.when(~known, F.lit(None))
        .when(part["pull"] == "pull", "pr")
        .when((part["kind"] == "blob") & (part["path"] != ""), "file")
        .when(part["kind"] == "tree", "tree")
        .otherwise("repo")
    )
    return F.struct(
        F.when(known, part["owner"]).alias("owner"),
        F.when(known, part["repo"]).alias("repo"),
        kind.alias("type"),
        F.when(kind.isin("file", "tree"), part["ref"]).when(kind == "repo", "main").alias("ref"),
        F.when(kind.isin("file", "tree"), part["path"]).alias("path"),
        F.when(kind == "pr", part["number"].try_cast("int")).alias("pr_number"),
    )
