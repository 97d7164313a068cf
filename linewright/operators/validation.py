"""Checks on a file list before it is accepted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright import fixed_values as fv
from linewright.functions import text

_MB = 1024 * 1024


def validate(
    files: DataFrame,
    max_files: int = fv.MAX_FILES,
    max_file_mb: float = fv.MAX_FILE_MB,
    max_total_mb: float = fv.MAX_TOTAL_MB,
) -> DataFrame:
    """Error rows ``(review_id, ord, check_ord, field, message)``.

    Errors of one review sort by ``(ord, check_ord)``: too many files first, then file by
    file, the total size last. Review totals are aggregated once and file checks need no
    shuffle, so neither depends on how many files one review has.
    """
    sized = files.select(
        "review_id",
        "file_ord",
        "filename",
        F.octet_length("content").cast("long").alias("bytes"),
    )
    totals = sized.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")
    )
    review_checks = F.array(
        F.when(
            F.col("n") > max_files,
            _error(F.lit(-1), 0, F.lit("files"), F.lit(f"Too many files. Maximum is {max_files}.")),
        ),
        F.when(
            F.col("bytes") > max_total_mb * _MB,
            _error(
                F.lit(2**62), 0, F.lit("files"),
                F.lit(f"Total upload size exceeds {max_total_mb}MB limit."),
            ),
        ),
    )
    ext = text.extension(F.col("filename"))
    file_checks = F.array(
        F.when(
            F.col("bytes") > max_file_mb * _MB,
            _error(F.col("file_ord"), 1, F.col("filename"),
                   F.lit(f"File exceeds {max_file_mb}MB limit.")),
        ),
        F.when(
            ~text.one_of(ext, fv.UPLOAD_EXTENSIONS),
            _error(F.col("file_ord"), 2, F.col("filename"),
                   F.concat(F.lit("File extension ."), ext, F.lit(" is not allowed."))),
        ),
    )
    return _rows(totals, review_checks).unionByName(_rows(sized, file_checks))


def accepted(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Files of the reviews without any error."""
    return files.join(errors.select("review_id").distinct(), "review_id", "left_anti")


def _error(order, check, field, message):
    return F.struct(
        order.cast("long").alias("ord"),
        F.lit(check).alias("check_ord"),
        field.alias("field"),
        message.alias("message"),
    )


def _rows(df: DataFrame, checks) -> DataFrame:
    return df.select("review_id", F.explode(F.array_compact(checks)).alias("error")).select(
        "review_id", "error.*"
    )
