"""Instruction texts need no contents, so none are stored on the way."""

import glob

from linewright.plans import fix_queries
from linewright.session import shared_dir


def test_system_prompts_store_no_piece_texts(spark):
    def pieces():
        return set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/chunks-*"))

    before = pieces()
    assert fix_queries.system_prompts(spark, "/root/testdata/sf0.001").count() > 0
    (new,) = pieces() - before
    stored = spark.read.parquet(new)
    assert stored.count() > 0 and "content" not in stored.columns
