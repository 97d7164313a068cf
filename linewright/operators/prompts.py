"""Text datasets for model requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text
from linewright.operators.batching import COMPONENT
from linewright.operators import structure
from linewright.session import cut_lineage

BATCH = [*COMPONENT, "batch_ord"]
FILE = ["review_id", "file_id"]


def _place() -> Column:
    """Order inside a batch: the piece of a cut file first, then larger files first where
    the component was split, in input order otherwise."""
    return F.struct(
        F.col("chunk_ord").isNull().alias("whole"),
        F.when(F.col("split"), -F.col("tokens")).otherwise(0).alias("size"),
        "file_ord",
    )


def batch_files(batches: DataFrame, files: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Rows of ``create_batches`` with name, language, content and place in the batch."""
    named = files.select(*FILE, "filename", "language", "content")
    split = F.max("batch_ord") > 0
    parts = batches.groupBy(*COMPONENT).agg((split | F.bool_or(F.col("chunk_ord").isNotNull())).alias("split"))
    rows = batches.join(parts, COMPONENT)
    if chunks is None:
        rows = rows.join(named, FILE)
    else:
        # A piece brings its own text, so no row of a cut file carries the whole of it.
        pieces = chunks.select("file_id", "chunk_ord", "content")
        cut = rows.where("chunk_ord IS NOT NULL").join(named.drop("content"), FILE).join(pieces, ["file_id", "chunk_ord"])
        rows = rows.where("chunk_ord IS NULL").join(named, FILE).unionByName(cut)
    return rows.withColumn("place", _place())


def system_prompts(batched: DataFrame, profile: str = "full") -> DataFrame:
    """One instruction text per batch; languages in the order they first appear.

    A batch is bounded by its token budget, so gathering its files is bounded too.
    """
    ordered = F.array_sort(F.collect_list(F.struct("place", "language")))
    languages = batched.groupBy(*BATCH).agg(F.array_distinct(ordered["language"]).alias("languages"))
    template = F.replace(F.lit(fv.SYSTEM_TEXT), F.lit("<profile>"), F.lit(fv.PROFILE_TEXT[profile]))
    return languages.select(
        *BATCH,
        F.replace(template, F.lit("<languages>"), F.array_join("languages", ", ")).alias("prompt"),
    )


def _listed(label: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{label}: "), F.array_join(values, ", ")))


def describe(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Optional lines per file: what it exports, imports and defines.

    Each list belongs to one file, whose content was one cell to begin with. ``found`` are the files'
    ``structure.facts`` (functions and imports); they are written out here where a caller has none, as
    both kinds come out of one pass over the contents.
    """
    if found is None:
        found = cut_lineage(structure.facts(files, "function", "import"), "facts")

    def gather(rows: DataFrame, keys: list[str], *order: str, value: Column, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct(*order, value.alias("value"))))
        return rows.groupBy(*keys).agg(listed["value"].alias(name))

    exported = gather(structure.exports(files), FILE, "line_no", value=F.col("name"), name="exports")
    imported = gather(structure.imports(files, found), FILE, "line_no", "part", value=F.col("source"), name="imports")
    shown = F.concat(
        F.col("name"), F.lit("("), F.array_join("params", ", "),
        F.lit(") [complexity: "), F.col("complexity").cast("string"), F.lit("]"),
    )
    defined = gather(structure.functions(files, found), FILE, "part", value=shown, name="functions")
    joined = files.select(*FILE)
    for part in (exported, imported, defined):
        joined = joined.join(part, FILE, "left")
    return joined.select(
        *FILE,
        F.concat_ws(
            "\n", _listed("Exports", F.col("exports")), _listed("Imports", F.col("imports")),
            _listed("Functions", F.col("functions")),
        ).alias("described"),
    )


def user_messages(batched: DataFrame, described: DataFrame) -> DataFrame:
    """The files of a batch as one message, bounded like the batch."""
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("--- FILE: "), F.col("filename"), F.lit(" ---")),
        F.concat(F.lit("Language: "), F.col("language")),
        F.nullif("described", F.lit("")),
        F.lit(""),
        F.col("content"),
        F.lit("--- END FILE ---\n"),
    )
    rows = batched.join(described, FILE, "left").withColumn("block", block)
    blocks = F.array_sort(F.collect_list(F.struct("place", "block")))
    return rows.groupBy(*BATCH).agg(blocks["block"].alias("blocks")).select(
        *BATCH,
        F.concat(
            F.lit("Review the following "), F.size("blocks").cast("string"), F.lit(" files:\n\n"),
            F.array_join("blocks", "\n"),
        ).alias("message"),
    )


def _block(filename: Column, language: Column | None, content: Column) -> Column:
    return F.concat(
        F.lit("### "), filename, F.lit("\n```"), text.fence_language(filename, language), F.lit("\n"),
        content, F.lit("\n```\n"),
    )


def question_tail(question: str) -> str:
    return f"\n\n---\n\n**Question:** {question}"


def task_segments(files: DataFrame, task: str, question: str | None = None) -> DataFrame:
    """The document of a task, one row per file, to be joined by line ends in order.

    A request may name any number of files, so its document stays in rows: writing them
    in order gives the text, and no task ever holds the whole of it.
    """
    if task not in fv.TASK_TEXT:
        raise ValueError(f"unknown task {task}")
    if task == "ask" and not question:
        raise ValueError("the ask task needs a question")
    language = F.col("language") if "language" in files.columns else None
    segments = files.select(
        "review_id",
        F.lit(task).alias("task"),
        F.col("file_ord").alias("part"),
        _block(F.col("filename"), language, F.col("content")).alias("text"),
    )
    if task == "ask":
        tails = files.select("review_id").distinct().select(
            "review_id", F.lit(task).alias("task"), F.lit(2**62).alias("part"),
            F.lit(question_tail(question)).alias("text"),
        )
        segments = segments.unionByName(tails)
    return segments


def task_documents(files: DataFrame, task: str, question: str | None = None) -> DataFrame:
    """Instruction, length and token estimate of each request, summed map-side."""
    segments = task_segments(files, task, question)
    tail = F.lit(2**62)
    sized = segments.groupBy("review_id", "task").agg(
        F.count_if(F.col("part") != tail).alias("files"),
        F.sum(text.utf16_length(F.col("text")).cast("long")).alias("_units"),
    )
    system = fv.TASK_TEXT[task]
    # One line end between two files; the question brings its own.
    chars = F.col("_units") + F.col("files") - 1
    return sized.select(
        "review_id", "task", "files", F.lit(system).alias("system"), chars.alias("user_chars"),
        F.ceil((chars + len(system.encode("utf-16-le")) // 2) / fv.CHARS_PER_TOKEN).cast("long").alias("tokens"),
    )
