"""Import graph: which file an import means, and which files hang together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.session import cut_lineage, drop_folder, fresh_path


def import_candidates(source) -> F.Column:
    """Names a source may stand for, best first; the importing folder plays no part."""
    base = F.regexp_replace(F.regexp_replace(source, r"^\./", ""), r"^\.\./", "")
    last = F.substring_index(source, ".", -1)
    module = F.regexp_replace(source, r"^\.+", "")
    return F.array_compact(
        F.array(
            *[F.concat(base, F.lit(suffix)) for suffix in fv.IMPORT_SUFFIXES],
            *[
                F.when(source.contains(".") & (last != ""), F.concat(last, F.lit(suffix)))
                for suffix in fv.IMPORT_LAST_PART_SUFFIXES
            ],
            F.when(source.startswith("."), F.concat(module, F.lit(fv.IMPORT_MODULE_SUFFIX))),
        )
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative imports with the file of the same review they mean.

    The answer depends on review and source alone, so each pair is looked up once, however
    many files import it. The imports are written out first: they are needed twice, and
    they are narrow rows out of a read of all contents.
    """
    relative = cut_lineage(imports.where("is_relative"), "imports")
    asked = relative.select("review_id", "source").distinct()
    candidates = asked.select(
        "review_id", "source", F.posexplode(import_candidates(F.col("source"))).alias("rank", "filename")
    )
    names = files.groupBy("review_id", "filename").agg(F.min("file_id").alias("target_id"))
    resolved = (
        # Spark does not see that the candidates are many per source, so their size is no ground for a broadcast.
        candidates.hint("merge").join(names, ["review_id", "filename"])
        .groupBy("review_id", "source")
        .agg(F.min(F.struct("rank", "target_id", "filename")).alias("best"))
        .select("review_id", "source", "best.target_id", F.col("best.filename").alias("target"))
    )
    return relative.join(resolved, ["review_id", "source"])


def _keep(edges: DataFrame) -> tuple[DataFrame, str, tuple]:
    """Write the edges out; count and hash sums are observed while they are written."""
    mark = F.xxhash64("u", "v")
    seen = Observation()
    watched = edges.observe(
        seen,
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(mark).alias("xor"),
        F.sum(F.pmod(mark, F.lit(1 << 31))).alias("sum"),
    )
    path = fresh_path(edges.sparkSession, "edges")
    watched.write.parquet(path)
    return edges.sparkSession.read.parquet(path), path, tuple(seen.get[k] for k in ("n", "xor", "sum"))


def connected_components(files: DataFrame, edges: DataFrame) -> DataFrame:
    """``component_id`` per file: the smallest file id that it is linked with.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) pull every edge
    towards the smallest neighbour and end in stars after about the logarithm of the
    longest path, where plain label spreading needs its length. A round is joins with one
    minimum per node, so a node with very many edges is only a skewed join side. Each round
    is written out, and the one before it deleted; two equal rounds end the loop. ``edges`` has ``src`` and ``dst``.
    """
    a, b = F.col("src"), F.col("dst")
    current, path, before = _keep(
        edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(lowest, "u")
            .where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        )
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(below, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(below.select("u", F.col("m").alias("v")))
            .distinct()
        )
        last = path
        current, path, after = _keep(small)
        drop_folder(last)
        if after == before:
            break
        before = after
    stars = current.select(F.col("u").alias("file_id"), F.col("v").alias("component_id"))
    return files.select("review_id", "file_id").join(stars, "file_id", "left").withColumn(
        "component_id", F.coalesce("component_id", "file_id")
    )
