import gzip
import random

from pyspark.sql import functions as F

from linewright.llm import exact_dedup, line_dedup, warc
from linewright.session import fresh_path


def test_directory_doubles_and_splits():
    rng = random.Random(4)
    for hashes in ([rng.getrandbits(10) for _ in range(4000)], [5] * 3000 + [6, 900], []):
        counts: dict = {}
        for h in hashes:
            counts[h] = counts.get(h, 0) + 1
        d = exact_dedup.Directory(counts, 10, 100)
        assert len(d.entries) == 1 << d.depth
        held: dict = {}
        for h, n in counts.items():
            bucket = d.entries[h >> (10 - d.depth)]
            depth, head = d.buckets[bucket]
            assert h >> (10 - depth) == head
            held.setdefault(bucket, []).append(n)
        for bucket, ns in held.items():
            assert sum(ns) <= 100 or d.buckets[bucket][0] == 10
        for bucket, (depth, _) in enumerate(d.buckets):
            assert d.entries.count(bucket) == 1 << (d.depth - depth)


def exact_model(rows):
    groups: dict = {}
    for i, (doc_id, text) in enumerate(rows):
        text = text or ""
        groups.setdefault(text.translate(dict.fromkeys(map(ord, exact_dedup.SPACE))), []).append(
            (-len(text), doc_id is None, doc_id or 0, i)
        )
    return sorted(
        (str(rows[i][0]), str(rows[min(g)[3]][0]), len(g))
        for g in groups.values() for *_, i in g
    ), len(groups)


def test_exact_classes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FOLD_BYTES", 300)
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abc", k=rng.randrange(4)))) for i in range(200)]
    rows += [(None, "a b"), (7, "a b"), (7, "a b"), (500, None), (501, " "), (502, "a\tb\n\x0b\x0c\r c"), (503, "abc" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS gid", "2 AS hash").repartition(5)
    got = exact_dedup.exact_duplicates(docs, capacity=3).collect()
    want, classes = exact_model(rows)
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == classes
    assert exact_dedup.exact_duplicates(docs.limit(0)).collect() == []


def test_equal_hashes_hang_in_a_chain():
    import pyarrow as pa

    rows = pa.table(
        {"bucket": pa.array([0] * 4, pa.int32()), "hash": [9, 9, 9, 10], "gid": [1, 2, 3, 4],
         "body": [b"x", b"y", b"x", b"x"], "n": [2, 1, 1, 1], "best_points": [5, 5, 7, 1], "best_id": [1, 2, None, 4],
         "best_uid": [1, 2, 3, 4]}
    )
    out = [r for b in exact_dedup._chain_batches(iter(rows.to_batches(max_chunksize=1))) for r in b.to_pylist()]
    assert {(r["gid"], r["class_size"], r["keep_uid"]) for r in out} == {(1, 3, 3), (3, 3, 3), (2, 1, 2), (4, 1, 4)}


def test_loser_tree_merges_like_sorting():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 7, 64):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(1, 30))) for _ in range(k)]
        flat = [x for r in runs for x in r]
        bounds, at = [], 0
        for r in runs:
            bounds.append((at, at + len(r)))
            at += len(r)
        order = list(warc.merge_runs(bounds, lambda i: flat[i]))
        assert [flat[i] for i in order] == sorted(flat) and len(set(order)) == len(flat)


def test_archives_and_capture_histories(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 7)
    body = "<p>" + "é" * 60 + "</p>"
    rows = [(i, f"http://www.b{i % 3}.Example.com:80/p{i % 4}?q#f", body if i % 2 else f"<p>{i}" + "x" * (i * 7)) for i in range(60)]
    rows += [(100, None, None), (101, "odd url", ""), (102, "http://a.org", "short"), (103, "http://a.org", "short"),
             (None, "http://a.org/\r\nx", body), (1, "http://b.org", body)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 AS offset").repartition(3)
    index = warc.merge_index(warc.write_warc(pages, fresh_path(spark, "w")), merge_rows=20)
    places = index.orderBy("part", "place").collect()
    assert index.select("part").distinct().count() > 1 and len(places) == len(rows)
    order = [(r["url_key"].encode(), r["ts"], r["page_id"] is not None, r["page_id"] or 0) for r in places]
    assert order == sorted(order)
    got = {(r["page_id"], r["url_key"]): r for r in warc.read_warc(index).collect()}
    assert len(got) == len(rows)
    for page_id, url, html in rows:
        r = got[page_id, warc.url_key(url)]
        payload = (html or "").encode()
        revisit = html == body and page_id != 1
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (
            len(payload), "revisit" if revisit else "response", 1 if revisit else None
        )
    one = places[0]
    with warc.open_input(one["path"]) as file:
        file.seek(one["offset"])
        fields, block = warc.parse_record(gzip.decompress(file.read(one["length"])))
    assert fields["WARC-Type"] == one["record_type"] and int(fields["Content-Length"]) == len(block)
    empty = warc.write_warc(pages.limit(0), fresh_path(spark, "w"))
    assert warc.read_warc(warc.merge_index(empty)).collect() == []


def test_url_keys():
    assert warc.url_key("https://user@WWW.Example.com:443/a?b#c") == "com,example)/a?b"
    assert warc.url_key("http://example.com:8080") == "com,example:8080)/"
    assert warc.url_key(None) == ""


def test_boilerplate_lines(spark):
    rows = [(i, "h", f"menu\n own {i} \nmenu\n\nfoot" if i < 6 else f"own {i}\nfoot") for i in range(10)]
    rows += [(20, None, "menu\nmenu"), (21, None, None), (None, "k", "x"), (3, "h", rows[3][2])]
    pages = spark.createDataFrame(rows, "page_id long, host string, text string").selectExpr("*", "1 AS mark")
    got = line_dedup.drop_boilerplate(pages, most_share=0.7, least_pages=3).collect()
    assert len(got) == len(rows)
    texts = sorted((str(r["page_id"]), r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got)
    want = []
    for page_id, host, text in rows:
        lines = [x.strip() for x in (text or "").split("\n") if x.strip()]
        # On h, foot is on all 11 pages and menu on 7 of 11, which is not above 0.7.
        kept = [x for x in lines if not (host == "h" and x == "foot")]
        want.append((str(page_id), len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert texts == sorted(want)
    assert line_dedup.drop_boilerplate(pages.limit(0)).collect() == []
    hosts = spark.createDataFrame([("HTTP://A.b:8/x",), ("x",), (None,)], "u string").select(line_dedup.host_of(F.col("u")).alias("h"))
    assert [r["h"] for r in hosts.collect()] == ["a.b", "", ""]
