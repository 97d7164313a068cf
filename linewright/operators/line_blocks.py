"""Contents as blocks of lines, for readers that want a few lines of a file each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.functions import text

FILE = ["review_id", "file_id"]
#: Lines of a block. A place with its context lies in one or two blocks unless it is longer than this.
LINES = 64


def line_blocks(files: DataFrame, keys: list[str] = FILE, lines: int = LINES) -> DataFrame:
    """``keys, block, text``: block ``b`` holds the lines from ``b * lines`` (the first is 0) on.

    One pass of one expression cuts a content, whatever its length; no task sorts or numbers lines.
    A content has at least one block; a null one has none.
    """
    # Up to lines - 1 whole lines and one more; after the last line an empty match may follow.
    piece = rf"(?:[^\n]*+\n){{0,{lines - 1}}}+[^\n]*+\n?"
    count = F.ceil(text.line_count(F.col("content")) / F.lit(lines)).cast("int")
    cut = F.slice(F.regexp_extract_all("content", F.lit(piece), F.lit(0)), F.lit(1), count)
    return files.where(F.col("content").isNotNull()).select(*keys, F.posexplode(cut).alias("block", "text"))


def block_lines(block_text: Column, lines: int = LINES) -> Column:
    """The lines of a block; a full one ends with the line end of its last line."""
    return F.slice(text.split_lines(block_text), F.lit(1), F.lit(lines))


def read_ranges(wanted: DataFrame, blocks: DataFrame, keys: list[str] = FILE, lines: int = LINES) -> DataFrame:
    """``keys, _from, _to, _text``: the lines from ``_from`` up to but not including ``_to``, joined.

    ``wanted`` has non-empty ranges that lie within their files. Each distinct range asks for its blocks by
    number, an equality; no row ever holds more of a content than one block.
    """
    first, last = (F.floor(F.col("_from") / lines), F.floor((F.col("_to") - 1) / lines))
    asked = wanted.select(*keys, "_from", "_to").distinct().withColumn("block", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    start = F.col("block") * lines
    low = F.greatest(F.col("_from") - start, F.lit(0)).cast("int")
    high = F.least(F.col("_to") - start, F.lit(lines)).cast("int")
    part = F.array_join(F.slice(block_lines(F.col("text"), lines), low + 1, high - low), "\n")
    found = asked.join(blocks, [*keys, "block"]).select(*keys, "_from", "_to", F.struct("block", part.alias("part")).alias("_p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["part"]), "\n")
    return found.groupBy(*keys, "_from", "_to").agg(joined.alias("_text"))
