"""What is found in files is found in one pass and handed on in small pieces."""

import pyarrow as pa

from linewright.operators import prompts, structure
from linewright.operators.code_shape import Shape
from linewright.plans.registry import QUERIES
from tests.oracle import load_all


def test_imports_need_no_brackets():
    shape = Shape("import a from './b'\nfunction f(x) { if (x) { } }", "typescript")
    assert shape.imports() == [(0, "./b")]
    assert not {"pairs", "braces", "_branches"} & set(vars(shape))
    assert [f["name"] for f in shape.functions()] == ["f"]


def test_facts_leave_a_task_in_small_pieces():
    many = "\n".join(f"def f{n}(a):\n    return {n}" for n in range(1500))
    rows = [(0, n, f"{n}.py", "python", many) for n in range(3)]
    names = ["review_id", "file_id", "filename", "language", "content"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])
    pieces = list(structure._found(iter([batch]), frozenset(["function"]), 4))
    assert max(p.num_rows for p in pieces) <= 1024
    got = [r for p in pieces for r in zip(p.column(1).to_pylist(), p.column(6).to_pylist())]
    assert got == [(i, f"f{n}") for i in range(3) for n in range(1500)]


def test_user_messages_read_each_content_once_for_their_facts(spark, monkeypatch):
    load_all()
    passes, facts = [], structure.facts

    def counted(*args, **kwargs):
        passes.append(args[1:])
        return facts(*args, **kwargs)

    monkeypatch.setattr(structure, "facts", counted)
    assert QUERIES["user_messages"](spark, "/root/testdata/sf0.001").count() > 0
    assert len(passes) == 1


def test_rows_of_a_cut_file_do_not_carry_the_whole_of_it(spark):
    files = spark.createDataFrame([(0, 1, "a.py", "python", "x\ny"), (0, 2, "b.py", "python", "z")],
                                  "review_id long, file_id long, filename string, language string, content string")
    batches = spark.createDataFrame(
        [(0, 1, 0, 1, 1, 0, 5), (0, 1, 1, 1, 1, 1, 5), (0, 1, 1, 2, 2, None, 1)],
        "review_id long, component_id long, batch_ord long, file_ord long, file_id long, chunk_ord long, tokens long",
    )
    chunks = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "file_id long, chunk_ord long, content string")
    rows = prompts.batch_files(batches, files, chunks)
    assert sorted((r.batch_ord, r.file_id, r.filename, r.content) for r in rows.collect()) == [
        (0, 1, "a.py", "x"), (1, 1, "a.py", "y"), (1, 2, "b.py", "z")]
    # Contents of files are joined to whole ones alone: the piece is the only text of a cut one.
    assert "coalesce(content" not in rows._jdf.queryExecution().optimizedPlan().toString()
