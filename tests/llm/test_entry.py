"""Registered queries next to their SQL, and the pipeline next to a plain-Python model."""

import os
import random

import pytest
from tokenizers import Tokenizer

from linewright.llm import language, queries, token_files
from tests import oracle
from tests.llm import models

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(oracle, "QUERIES", queries.QUERIES)
    monkeypatch.setattr(oracle, "ORACLES", queries.ORACLES)
    good, note = oracle.compare(spark, oracle.connect(SF_DIR), SF_DIR, name)
    assert good, note


def test_one_query_per_operator_is_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_pipeline_equals_the_model(spark, tmp_path):
    import corpus_pipeline

    base = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()}
    rng = random.Random(1)
    rows = [tuple(r) for r in base]
    some = list(items.values())
    rows += [
        (9001, rows[3][1] + " " + some[0] + " end", "en", "src1", 0), (9002, rows[5][1], "en", None, 0),
        (9003, rows[5][1] + " tail", "en", "src2", 0), (9004, None, None, None, None), (9005, "", "en", "src3", 0),
        (None, "a row that has no id but words enough to be told apart", "en", "src4", 0), (9006, "12 34", "en", "src5", 0),
        (rows[7][0], rows[7][1], rows[7][2], rows[7][3], rows[7][4]),
    ]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    learned = tuple(sorted(language.learn(docs.where(~language.held_out())).items()))
    kept = [r for r in rows if not language.classify(r[1], learned, language.LEVEL, language.LEAST_MARGIN)[3]]
    distinct = list(dict.fromkeys(kept))
    classes = models.similar_classes({i: r[1] for i, r in enumerate(distinct)})
    first: dict = {}
    for i, r in enumerate(distinct):
        key = classes[i][0]
        if key not in first or (r[0] is None, r[0] or 0) < (distinct[first[key]][0] is None, distinct[first[key]][0] or 0):
            first[key] = i
    single = [distinct[i] for i in first.values()]
    leaks = models.leaks({i: r[1] for i, r in enumerate(single)}, items)
    clean = [r for i, r in enumerate(single) if not leaks[i]]
    copies = models.mix([(r[0], r[3], len((r[1] or "").split())) for r in clean])
    out = [r for r, n in zip(clean, copies) for _ in range(n)]
    library, start, want = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for r in sorted(out, key=lambda r: (r[0] is not None, r[0] or 0)):
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
        want.append((r[0], start, n))
        start += n
    assert len(clean) < len(single) < len(kept) < len(rows)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in got), key=lambda r: r[1]) == want
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "tokens"]


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _id int, _hash string, size int, kept string, " \
           "copies int, target double, lang_pred string, class_id long, text_hash string, _words int, _no int, _src int"


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path, empty):
    from linewright.llm import stages

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    extra = [n.split()[0] for n in CLASHING.split(", ")][5:]
    kinds = dict(n.split() for n in CLASHING.split(", "))
    rows = base.union(base.limit(2))
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a text that has no id", "en", None, 1), (7001, "", "en", "s", 0)], base.schema)
    docs = rows.union(odd).selectExpr("*", *[f"CAST(1 AS {kinds[n]}) AS {n}" for n in extra])
    docs.limit(0 if empty else 100).write.parquet(f"{tmp_path}/in")
    spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").limit(0 if empty else 100).write.parquet(f"{tmp_path}/benchmark.parquet")
    read = spark.read.parquet(f"{tmp_path}/in")
    for n, (name, stage) in enumerate(stages.STAGES):
        out = stage(spark, read, str(tmp_path))
        rows = out.collect()
        assert bool(rows) != empty, name
        if name != "tokens":
            assert out.columns == read.columns, name
            out.write.parquet(f"{tmp_path}/{n}")
            read = spark.read.parquet(f"{tmp_path}/{n}")


def test_pipeline_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
