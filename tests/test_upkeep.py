"""Sources and sinks with faults: broken files, answers that fail, writes that stop."""

import gzip
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from tallygrove.operators import tables
from tallygrove.sources import documents, versions
from tallygrove.sources.catalog import CatalogSource
from tallygrove.streaming.ingest import ingest


@pytest.fixture(scope="module")
def server():
    asked: dict[str, int] = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] = asked.get(self.path, 0) + 1
            rows = json.dumps([{"code": f"{self.path}{k}", "seats": k, "more": {"a": [1]}} for k in range(2)]).encode()
            body, status = {"/plain": (rows, 200), "/packed": (gzip.compress(rows), 200), "/one": (b'{"code": "x"}', 200), "/empty": (b"", 200), "/torn": (gzip.compress(rows)[:-12], 200), "/text": (b"<html>", 200), "/odd": (b'[1, {"code": null}]', 200), "/late": (rows, 200 if asked[self.path] > 2 else 503)}.get(self.path, (b"", 404))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", asked
    s.shutdown()


KIND = "url string, code string, seats string, more string, error string"


def test_catalogs_over_http(spark, server):
    base, asked = server
    spark.dataSource.register(CatalogSource)
    urls = [f"{base}/{x}" for x in ("plain", "packed", "one", "empty", "torn", "text", "odd", "late", "none")]
    df = spark.read.format("catalog").schema(KIND).option("urls", " ".join(urls)).option("wait", "0.01").load()
    assert df.rdd.getNumPartitions() == len(urls)
    got = {}
    for r in df.collect():
        got.setdefault(r.url.rsplit("/", 1)[1], []).append(r)
    for name in ("plain", "packed", "late"):
        assert [(r.code, r.seats, r.more, r.error) for r in got[name]] == [(f"/{name}{k}", str(k), '{"a": [1]}', None) for k in range(2)]
    assert [r.code for r in got["one"]] == ["x"] and "empty" not in got and [r.code for r in got["odd"]] == [None, None]
    assert all(len(got[x]) == 1 and got[x][0].error and got[x][0].code is None for x in ("torn", "text", "none"))
    assert asked["/none"] == 1 and asked["/late"] == 3 and asked["/torn"] == 3
    assert spark.read.format("catalog").schema("code string").option("urls", urls[0]).load().count() == 2


def test_catalogs_as_a_stream(spark, server, tmp_path):
    base, asked = server
    spark.dataSource.register(CatalogSource)
    lines = tmp_path / "urls"
    before = asked.get("/plain", 0)
    for more in (["plain"], ["one", "packed"], []):
        with lines.open("a") as f:
            f.writelines(f"{base}/{x}\n" for x in more)
        df = spark.readStream.format("catalog").schema(KIND).option("list", str(lines)).load()
        df.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.code for r in got.collect()) == ["/packed0", "/packed1", "/plain0", "/plain1", "x"]
    assert asked["/plain"] == before + 1


def test_broken_documents_are_told_of(spark, tmp_path):
    good = {"round": "", "programs": [{"tcas_code": "A"}]}
    files = {"001_R1.json": json.dumps(good), "002_R2.json": json.dumps(good)[:-4], "003_R1.json": " \n", "004_R1.json": "[1]", "005_R1.json": '{"a": 1}', "006_R3_admission.json": "{", "007_R4.json": json.dumps(good | {"x": 1}, indent=1)}
    (tmp_path / "in").mkdir()
    for name, text in files.items():
        (tmp_path / "in" / name).write_text(text)
    docs, bad = documents.read_documents_checked(spark, str(tmp_path))
    assert sorted((r.university_id, r.round, len(r.programs)) for r in docs.collect()) == [("001", "R1", 1), ("007", "R4", 1)]
    assert {r.path.rsplit("/", 1)[1][:3]: r.reason for r in bad.collect()} == {"002": "broken JSON", "003": "empty", "004": "broken JSON", "005": "no programs and no items"}
    assert set(docs.columns) == set(documents.read_documents(spark, str(tmp_path / "in")).columns)
    assert documents.programs_of(docs).count() == 2


def test_only_changed_partitions_are_written(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    kind = "u string, r int, x int, s string"
    rows = [("001", k % 3, k, "é") for k in range(9)] + [(None, 7, 1, None), ("a b/c", 1, 2, ""), ("a b/c", 1, 2, "")]
    frame = lambda rs: spark.createDataFrame(rs, kind).repartition(3)
    table = lambda v=None: sorted(map(tuple, versions.read(spark, root, v).select("u", "r", "x", "s").collect()), key=str)
    as_text = lambda rs: sorted([(u, str(r), x, s) for u, r, x, s in rs], key=str)
    with pytest.raises(ValueError):
        versions.read(spark, root)
    assert versions.update(frame(rows), root, ["u", "r"]) == {"written": 5, "kept": 0, "dropped": 0}
    assert table() == as_text(rows)
    # the same rows in another order: nothing is written
    files = sorted(tmp_path.rglob("*.parquet"))
    assert versions.update(frame(rows[::-1]), root, ["u", "r"]) == {"written": 0, "kept": 5, "dropped": 0}
    assert sorted(tmp_path.rglob("*.parquet")) == files
    # one partition changes, one is new, the others stay where they are
    new = [(u, r, x + (r == 2), s) for u, r, x, s in rows] + [("002", 1, 1, "n")]
    assert versions.update(frame(new), root, ["u", "r"]) == {"written": 2, "kept": 4, "dropped": 0}
    assert table() == as_text(new) and table(1) == as_text(rows) and set(files) <= set(tmp_path.rglob("*.parquet"))
    # a write that fails half-way leaves the table, and the next one takes another version
    broken = frame(new).withColumn("x", F.when(F.col("r") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("x") + 1))
    with pytest.raises(Exception, match="stop"):
        versions.update(broken, root, ["u", "r"]).items()
    assert table() == as_text(new)
    (tmp_path / "t/data/v=3").mkdir()
    few = [r for r in new if r[0] == "001"]
    assert versions.update(frame([(u, r, x, "z") for u, r, x, s in few]), root, ["u", "r"], replace=True)["dropped"] == 3
    assert table() == as_text([(u, r, x, "z") for u, r, x, s in few])
    assert versions.sweep(spark, root) == [1, 2, 3] and table() == as_text([(u, r, x, "z") for u, r, x, s in few])


def test_keys_are_kept_by_state(spark, tmp_path):
    """The first row of a key, whatever batch it comes in; a batch doesn't look at the sink, which may be gone."""
    src, kind = tmp_path / "in", "key string, v long, at timestamp, xs array<int>"
    run = lambda sink: ingest(spark, str(src), kind, ["key"], ["v"], str(tmp_path / sink), str(tmp_path / "cp")).awaitTermination()
    big = 2**60 + 1
    lots = [[("a", big, 1), ("a", big - 1, 2), (None, 5, 3)], [("a", 0, 4), ("b", None, 5), (None, 1, 6)], [("b", 1, 7), ("c", 9, 8)]]
    for k, lot in enumerate(lots):
        df = spark.createDataFrame(lot, "key string, v long, n int").select("key", "v", F.timestamp_seconds(F.col("n") + F.lit(0.25)).alias("at"), F.array("n", F.lit(None).cast("int")).alias("xs"))
        df.coalesce(1).write.mode("append").parquet(str(src))
        run(f"out{k // 2}")  # the last batch has another sink
    got = {r.key: (r.v, r.at.microsecond, r.xs) for k in range(2) for r in spark.read.parquet(str(tmp_path / f"out{k}")).collect()}
    assert got == {"a": (big - 1, 250000, [2, None]), None: (5, 250000, [3, None]), "b": (None, 250000, [5, None]), "c": (9, 250000, [8, None])}


def test_vocabulary(spark):
    rows = [(k, c, w) for k in range(6) for c, w in (("x", 1.0), ("x", 2.0), ("y" if k < 5 else None, 1.0), ("rare" if k < 4 else "z", -3.0))]
    df = spark.createDataFrame(rows, "id int, c string, w double")
    v = tables.vocabulary(df, ["id"], "c")
    assert sorted(map(tuple, v.collect())) == [("x", 6, 0), ("y", 5, 1)]
    got = {r.id: (r.features, r.weights) for r in tables.sparse_vectors(df, ["id"], "c", "w", v).collect()}
    assert got == {k: ([0, 1], [3.0, 1.0]) if k < 5 else ([0], [3.0]) for k in range(6)}
