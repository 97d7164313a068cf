"""Stored tables that change, next to dictionaries."""

import random

import pytest
from pyspark.sql import functions as F

from linewright.sources.keyed import KeyedStore

TABLES = {"reviews": "review_id long, status string", "files": "review_id long, file_id long, score int"}


def contents(store):
    return tuple(sorted((tuple(r) for r in store.read(t).collect()), key=repr) for t in TABLES)


def test_changes_follow_a_dictionary(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", TABLES, "review_id", buckets=3)
    assert contents(store) == ([], [])
    rng = random.Random(1)
    reviews, files = {}, {}
    for step in range(6):
        ids = rng.sample([None, *range(12)], 4)
        new_reviews = [(i, f"s{step}") for i in ids]
        new_files = [(i, f, step * 10 + f) for i in ids for f in rng.sample(range(5), 2)]
        gone = rng.sample([None, *range(12)], 2) if step % 2 else []
        store.change(
            {
                "reviews": (spark.createDataFrame(new_reviews, TABLES["reviews"]), ["review_id"]),
                "files": (spark.createDataFrame(new_files, TABLES["files"]), ["review_id", "file_id"]),
            },
            spark.createDataFrame([(g,) for g in gone], "review_id long") if gone else None,
        )
        for g in gone:
            reviews.pop(g, None)
            files = {k: v for k, v in files.items() if k[0] != g}
        reviews.update(dict(new_reviews))
        files.update({(i, f): s for i, f, s in new_files})
        assert contents(store) == (
            sorted(reviews.items(), key=repr), sorted(((i, f, s) for (i, f), s in files.items()), key=repr)
        )
        if step % 2:
            store.vacuum()
    assert store.commits() == [5]
    # After a vacuum the folders hold the current rows and nothing else.
    assert spark.read.parquet(f"{tmp_path}/s/rows/files").count() == len(files)
    again = KeyedStore(spark, f"{tmp_path}/s", TABLES, "review_id", buckets=3)
    assert contents(again)[0] == sorted(reviews.items(), key=repr)


def test_a_failed_change_leaves_the_old_state(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", TABLES, "review_id", buckets=2)
    rows = spark.createDataFrame([(n, "new") for n in range(8)], TABLES["reviews"])
    store.change({"reviews": (rows, ["review_id"])})
    before = contents(store)
    broken = spark.createDataFrame([(1, 5, 5)], TABLES["files"]).withColumn("score", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        # The first table of the change is written, the second fails, so neither counts.
        store.change({"reviews": (rows.withColumn("status", F.lit("half")), ["review_id"]), "files": (broken, ["review_id", "file_id"])})
    assert contents(store) == before
    store.change({"reviews": (rows.where("review_id < 3").withColumn("status", F.lit("whole")), ["review_id"])})
    assert contents(store)[0] == sorted([(n, "whole" if n < 3 else "new") for n in range(8)])


def test_a_repeated_commit_changes_nothing(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", TABLES, "review_id", buckets=2)
    first = spark.createDataFrame([(1, "a")], TABLES["reviews"])
    store.change({"reviews": (first, ["review_id"])}, commit=4)
    store.change({"reviews": (first.withColumn("status", F.lit("b")), ["review_id"])}, commit=4)
    assert contents(store)[0] == [(1, "a")]
    store.change({"reviews": (first.limit(0), ["review_id"])}, commit=5)
    assert contents(store)[0] == [(1, "a")] and store.commits() == [4, 5]


def test_a_change_touches_the_buckets_of_its_keys(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", TABLES, "review_id", buckets=16)
    rows = spark.createDataFrame([(n, "x") for n in range(400)], TABLES["reviews"])
    store.change({"reviews": (rows, ["review_id"])})
    store.change({"reviews": (rows.where("review_id = 7"), ["review_id"])})
    written = spark.read.parquet(f"{tmp_path}/s/rows/reviews").where("_version = 1")
    assert written.select("_bucket").distinct().count() == 1 and written.count() < 60


def _joins(spark, run) -> int:
    """Joins in the plans of what ``run`` writes in buckets."""
    plans = []
    write = KeyedStore._write

    def told(self, table, rows, number):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        write(self, table, rows, number)

    KeyedStore._write = told
    try:
        run()
    finally:
        KeyedStore._write = write
    return sum(plan.count("Join ") for plan in plans)


def test_changes_join_no_more_than_they_must(spark, tmp_path):
    store = KeyedStore(spark, f"{tmp_path}/s", TABLES, "review_id", buckets=2)
    rows = spark.createDataFrame([(n, "new") for n in [None, *range(8)]], TABLES["reviews"])
    # Nothing is stored, so nothing can be replaced.
    assert _joins(spark, lambda: store.change({"reviews": (rows, ["review_id"])}, rows.select("review_id"))) == 0
    changes = spark.createDataFrame([(3, "old"), (99, "none"), (4, None)], TABLES["reviews"])
    assert _joins(spark, lambda: store.update("reviews", changes, ["review_id"])) == 1
    want = {3: "old", 4: None}
    assert contents(store)[0] == sorted([(n, want.get(n, "new")) for n in [None, *range(8)]], key=repr)
    assert store.update("files", spark.createDataFrame([(3, 1, 5)], TABLES["files"]), ["review_id", "file_id"]) == 2
    assert contents(store)[1] == [] and store.commits() == [0, 1, 2]


def test_reviews_are_saved_updated_and_deleted(spark, tmp_path):
    from linewright.sources.review_store import ReviewStore

    ddl = ("review_id long, status string, project_score int", "review_id long, file_ord int, name string",
           "review_id long, file_ord int, ord long, message string, feedback string")

    def tables(ids, mark):
        return (
            spark.createDataFrame([(i, "ANALYZING", None) for i in ids], ddl[0]),
            spark.createDataFrame([(i, f, f"{mark}{i}-{f}") for i in ids for f in range(2)], ddl[1]),
            spark.createDataFrame([(i, f, n, mark, None) for i in ids for f in range(2) for n in range(2)], ddl[2]),
        )

    store = ReviewStore(spark, f"{tmp_path}/r", *ddl, buckets=3)
    store.save(*tables(range(6), "a"))
    reviews, files, findings = tables([2], "b")
    store.save(reviews, files.where("file_ord = 0"), findings.where("file_ord = 0"))  # a review once more, with less
    store.update_reviews(spark.createDataFrame([(1, "COMPLETED", 88), (77, "COMPLETED", 1)], "review_id long, status string, project_score int"))
    store.set_feedback(spark.createDataFrame(
        [(1, 0, 1, "first", 1), (1, 0, 1, "second", 5), (2, 1, 0, "to nothing", 1)], "review_id long, file_ord int, ord long, feedback string, seq long"
    ))
    store.delete(spark.createDataFrame([(0,), (5,), (99,)], "review_id long"))
    assert sorted(map(tuple, store.read("reviews").collect())) == [
        (1, "COMPLETED", 88), (2, "ANALYZING", None), (3, "ANALYZING", None), (4, "ANALYZING", None)
    ]
    assert {r.name for r in store.read("files").collect()} == {"a1-0", "a1-1", "b2-0", "a3-0", "a3-1", "a4-0", "a4-1"}
    told = store.read("findings").where("feedback IS NOT NULL").collect()
    assert [tuple(r) for r in told] == [(1, 0, 1, "a", "second")] and store.read("findings").count() == 14
    assert sorted(r.ord for r in store.read("findings", 2).collect()) == [0, 1]
