"""Sources, snapshots, request texts, the engine and the request stream."""

import os
import socket
import threading
import urllib.error
import urllib.request

import pytest
from model import FIXTURE, SEEDS
from test_requests import SEED, graph_of

from taxograph import workspace
from taxograph.__main__ import main
from taxograph.operators.actions import REQUEST
from taxograph.operators.graph import build_graph
from taxograph.plans import requests as R
from taxograph.plans.engine import Engine
from taxograph.plans.http import server
from taxograph.sources import links as L
from taxograph.sources import snapshots as S
from taxograph.streaming.served import serve


def test_dump(spark, tmp_path):
    path = tmp_path / "dump.txt"
    path.write_text("".join(f"{c} {p} {t}\n" for c, p, t in FIXTURE) + "\n  \n")
    rows = L.read_dump(spark, str(path)).orderBy("seq").collect()
    assert [(r["child"], r["parent"], r["type"]) for r in rows] == FIXTURE
    assert build_graph(L.read_dump(spark, str(path)), strict=True).limit == 5_800_001
    path.write_text("1 2 f\nbroken line\n3\t4\tsubcat\n")
    assert L.read_dump(spark, str(path), fail=False).count() == 2
    with pytest.raises(Exception, match="malformed"):
        L.read_dump(spark, str(path)).collect()


def test_titles_and_ranges(spark):
    page = spark.createDataFrame([(1, 14, "A"), (2, 14, "B"), (3, 6, "A"), (4, 14, None), (5, 14, "A")], "page_id int, page_namespace int, page_title string")
    links = spark.createDataFrame([(9, bytearray(b"A"), "file"), (8, bytearray(b"B"), "page"), (7, bytearray(b"C"), "file"), (6, None, "file"), (5, bytearray(b"B"), "subcat")], "cl_from int, cl_to binary, cl_type string")
    assert sorted(map(tuple, L.titled_links(page, links).collect())) == [(5, 2, "subcat"), (9, 1, "file"), (9, 5, "file")]
    assert L.largest_page_id(page).first()[0] == 5 and L.largest_page_id(page.limit(0)).first()[0] == 0
    assert list(L.id_ranges(0, 25, 10)) == [(0, 10), (10, 20), (20, 25)] and list(L.id_ranges(5, 5)) == []
    options = L.read_jdbc(spark, "jdbc:x", "t", 0, 250_000, dry_run=True, user="u")
    assert options["numPartitions"] == "3" and options["fetchsize"] == "10000" and options["user"] == "u"


def test_request_texts():
    q = R.QueryRequest.from_params({"c1": "12x", "a": "not", "d1": "junk", "s": "5"})
    assert q.row() == (0, "not", 12, 12, 0, -1, 0, 5)
    for bad in ({}, {"c1": "1", "a": "zap"}, {"c1": "1", "a": "path"}, {"c1": "1", "c2": "1", "a": "path"}):
        with pytest.raises(R.RequestError):
            R.QueryRequest.from_params(bad)
    lines = R.result_lines([(i, 0, 0) for i in range(101)])
    assert [x.count("|") for x in lines] == [49, 49, 0] and lines[2] == "RESULT 100,0,0"
    assert R.rendered(R.Transport.JS, ["RESULT 1,0,0", "OUTOF 1"], "cb") == ["cb( [ 'RESULT 1,0,0', 'OUTOF 1', 'DONE'] );"]
    assert R.rendered(R.Transport.SOCKET, ["NOPATH"]) == ["COMPUTE_START", "NOPATH", "DONE"]


def test_dump_of_several_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("1 9 f\n")
    (tmp_path / "d" / "b.txt").write_text("".join(f"{i} 1 f\n" for i in range(2, 3000)))
    rows = L.read_dump(spark, str(tmp_path / "d")).orderBy("seq").collect()
    assert [r["child"] for r in rows] == list(range(1, 3000))
    assert build_graph(L.read_dump(spark, str(tmp_path / "d")), strict=True).limit == 2


def test_unsound_graph_is_not_written(spark, tmp_path):
    with pytest.raises(ValueError, match="unsound"):
        S.write_snapshot(graph_of(spark, [(1, 2, "f"), (3, 1, "s"), (5, 3, "f")]), str(tmp_path / "db"))
    assert S.current_version(spark, str(tmp_path / "db")) is None


def test_commands(spark, tmp_path, capsys):
    dump, folder = tmp_path / "dump.txt", str(tmp_path / "db")
    dump.write_text("".join(f"{c} {p} {t}\n" for c, p, t in FIXTURE))
    main(["build", str(dump), folder], spark)
    assert S.current_version(spark, folder) == capsys.readouterr().out.strip()
    main(["inspect", folder, "subcats", "1"], spark)
    assert capsys.readouterr().out == "parent\tpos\tchild\n1\t1\t2\n1\t2\t3\n"
    page, links, out = str(tmp_path / "page"), str(tmp_path / "links"), str(tmp_path / "db2")
    spark.createDataFrame([(1, 14, "A"), (2, 14, "B"), (3, 6, "C")], "page_id int, page_namespace int, page_title string").write.parquet(page)
    spark.createDataFrame([(2, "A", "subcat"), (3, "B", "file"), (3, "Z", "file")], "cl_from int, cl_to string, cl_type string").write.parquet(links)
    main(["extract", page, links, out, "--batch", "2", "--dry-run"], spark)
    assert capsys.readouterr().out == "0 2\n2 4\n"
    main(["extract", page, links, out], spark)
    graph, meta = S.read_snapshot(spark, out)
    assert [tuple(r) for r in graph.subcats.collect()] == [(1, 1, 2)] and [tuple(r) for r in graph.files.collect()] == [(2, 3)] and meta["limit"] == 3


def socket_messages(port, path):
    """All text messages of a websocket until it is closed."""
    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall(f"GET {path} HTTP/1.1\r\nHost: x\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Key: dGhlIHNhbXBsZSBub25jZQ==\r\nSec-WebSocket-Version: 13\r\n\r\n".encode())
        f = s.makefile("rb")
        head = [f.readline() for _ in range(5)]
        assert b"101" in head[0] and b"s3pPLMBiTxaQ9kYGzzhZRbK+xOo=" in b"".join(head)  # the example of the RFC
        out = []
        while (kind := f.read(1)[0]) == 0x81:
            n = f.read(1)[0]
            n = int.from_bytes(f.read(2 if n == 126 else 8)) if n > 125 else n
            out.append(f.read(n).decode())
        assert kind == 0x88
        return out


def test_engine_and_stream(spark, tmp_path):
    folder = str(tmp_path / "db")
    with pytest.raises(ValueError):
        S.read_snapshot(spark, folder)
    first = S.write_snapshot(graph_of(spark, FIXTURE), folder)
    seeds = spark.createDataFrame(SEEDS, SEED)
    engine = Engine(spark, folder, seeds, callback="shown")
    told = []
    lines = engine.submit({"c1": "1", "d1": "15", "s": "200", "a": "fqv"}, tell=told.append).result()
    assert lines[:2] == ["RESULT 5,0,1|4,0,1|7,1,3|8,1,4\n", "OUTOF 4\n"] and lines[2].startswith("DBAGE ") and lines[3] == "DONE\n"
    assert told == ["QUEUED 0"]
    assert engine.submit({"c1": "1", "d1": "15", "s": "200", "a": "fqv", "t": "js"}).result()[0].startswith("shown( [ 'RESULT 5,0,1|4,0,1|7,1,3|8,1,4', 'OUTOF 4', 'DBAGE ")
    assert engine.submit({"c1": "1", "c2": "100", "a": "path"}, socket=True).result()[:2] == ["COMPUTE_START", "NOPATH"]
    with pytest.raises(R.RequestError):
        engine.submit({"c1": "4"}).result()
    assert '"queue": 0' in engine.status() and '"relsize": 5800001' in engine.status()
    web = server(engine)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{web.server_address[1]}"
    assert urllib.request.urlopen(f"{base}/?c1=100&c2=200&a=not").read().decode().startswith("RESULT 102,0,0|103,1,0\nOUTOF 2\nDBAGE ")
    with pytest.raises(urllib.error.HTTPError, match="500"):
        urllib.request.urlopen(f"{base}/?c2=1")
    assert urllib.request.urlopen(f"{base}/status").headers["Access-Control-Allow-Origin"] == "*"
    assert socket_messages(web.server_address[1], "/?c1=1&d1=15&s=200&a=fqv")[-4:-2] == ["RESULT 5,0,1|4,0,1|7,1,3|8,1,4", "OUTOF 4"]
    said = socket_messages(web.server_address[1], "/?c1=100&c2=200&a=not")
    assert said[0] == "QUEUED 0" and said[-1] == "DONE" and "COMPUTE_START" in said and "RESULT 102,0,0|103,1,0" in said
    assert all(x.split()[0] in ("QUEUED", "WAITING", "WORKING", "COMPUTE_START", "RESULT", "OUTOF", "DBAGE", "DONE") for x in said)
    assert socket_messages(web.server_address[1], "/?c2=1") == []
    held = engine.submit({"c1": "100", "c2": "200", "a": "and"}, socket=True)
    behind = engine.submit({"c1": "100", "c2": "200", "a": "and"}, socket=True)
    notes = []
    engine.follow(behind, notes.append)
    assert held.done() and behind.progress() == "WORKING 4 4" and "WAITING 1" in notes
    assert not workspace._OPEN & {w for w in workspace._OPEN if "/answer-" in w.path}
    web.shutdown()
    full = Engine.__new__(Engine)
    full.__dict__ |= engine.__dict__ | {"waiting": 999}
    with pytest.raises(R.RequestError):
        full.submit({"c1": "1"})
    assert not engine.refresh()
    second = S.write_snapshot(graph_of(spark, FIXTURE[:8]), folder, buckets=2)
    assert second > first and engine.refresh() and engine.graph.limit == 7
    with pytest.raises(ValueError):
        S.publish(spark, folder, "v0")

    incoming = tmp_path / "requests"
    spark.createDataFrame([(1, "list", 1, None, None, None, None, None), (2, "list", 77, None, None, None, None, None)], REQUEST).write.parquet(str(incoming))
    stream = spark.readStream.schema(REQUEST).parquet(str(incoming))
    serve(engine, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()) == [4, 5]  # ids from 7 on lie beyond the last category
    assert spark.read.parquet(str(tmp_path / "out" / "rejected")).first()["reason"] == "id out of range"
    assert os.path.isdir(tmp_path / "out" / "totals")
