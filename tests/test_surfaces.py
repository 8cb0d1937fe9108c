"""Command line, shell, lines, tools and HTTP over one session."""

from __future__ import annotations

import io
import json
import threading
import urllib.request

import pytest

from cuewell.surfaces import cli, http, wire
from cuewell.surfaces.session import VERBS, Session


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # single rows
    s = Session(spark, str(tmp_path_factory.mktemp("db")))
    s.run("observe", "home", "the wifi password is hunter2. the room holds 50 chairs.")
    yield s
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_command_line(spark, session):
    out = io.StringIO()
    assert cli.main(["get", "home", "what", "is", "the", "wifi", "password"], session, out) == 0 and out.getvalue() == "hunter2\n"
    out = io.StringIO()
    assert cli.main(["recallmany", "home", "wifi", "password", "--json", "--k", "1"], session, out) == 0
    assert json.loads(out.getvalue())[0]["fact"] == "the wifi password is hunter2."
    assert cli.main(["get", "home", "zebra"], session, io.StringIO()) == 3
    assert Session(spark, session.folder).run("stats", "home") == {"facts": 2, "max_facts": 1_000_000}
    with pytest.raises(SystemExit):
        cli.main(["nonsense"], session, io.StringIO())


def test_verbs(session):
    assert session.run("setvar", "home", "door code = 1234") == "ok" and session.run("getvar", "home", "door code") == "1234"
    assert session.run("vars", "home") == {"door code": "1234"} and session.run("delvar", "home", "door code") == 1
    assert session.run("stance", "home", "rain: gloomy") == 1.0 and session.run("stance", "home", "Rain: cosy") == 2.0
    assert session.run("mood", "home", "calm") == "calm" and "calm" in session.run("affect", "home") and "cosy" in session.run("affect", "home")
    session.run("observe", "home", "rain fell on the garden all night")
    assert session.run("why", "home", "rain")["evidence"][0].startswith("rain fell")
    assert session.run("strengthen", "home", "wifi", bump=2.0) == {"strengthened": 1}
    assert session.run("upsert", "home", "the parcel is at the door", key="parcel")["new"]
    assert session.run("recallkeyed", "home", "parcel door", k=1)[0]["key"] == "parcel"
    assert session.run("forgetkey", "home", "parcel")["forgot"] == 1
    assert session.run("turn", "home", "what is the wifi password?")["reply"] == "hunter2"
    assert session.run("rewrite", "home", "the room holds 50 chairs. | the room holds 60 chairs")["facts"] == 3
    assert session.run("read", "home", start=0, limit=1)["total"] == 3
    assert session.run("chain", "home", "wifi | password")["value"] == "hunter2"
    assert "# scope: home" in session.run("export", "home") and session.run("caps", "", "fetch")["fetch"] == "host"
    assert session.run("assess", "home", "wifi password")["n_hits"] >= 1 and session.run("route", "home", "wifi password") == "ANSWER"
    assert session.run("forget", "home", "garden") == {"forgot": 1, "remaining": 2}


def test_marks_capture_and_learning(session):
    assert session.run("observe", "home", "the wifi password is swordfish")["contested"] > 0
    marked = session.run("recallscored", "home", "wifi password", k=2)
    assert [(m["contested"], m["with"]) for m in marked] == [(True, "the wifi password is swordfish"), (True, "the wifi password is hunter2.")]
    assert session.run("forget", "home", "swordfish")["forgot"] == 1
    out = io.StringIO()
    assert cli.main(["capture", "log", "--skip", "debug", "--json"], session, out, ["the pump is on\n", "debug the pump is off\n", "the pump is on\n", "valve seven leaks badly\r\n"]) == 0
    assert json.loads(out.getvalue()) == {"lines": 3, "facts": 2}
    assert cli.main(["run", "log", "echo", "the heater is broken"], session, io.StringIO()) == 0 and session.run("stats", "log")["facts"] == 3
    assert session.run("neighbors", "log", "valve") == [] and session.run("learn")["words"] > 3 and len(session.run("neighbors", "log", "valve", k=2)) == 2
    assert session.run("get", "home", "wifi password") == "hunter2"


def test_lines_and_shell(session):
    assert wire.mem(session, "get\thome\twifi password") == "hunter2" and wire.mem(session, "nope\thome") == ""
    out = io.StringIO()
    cli.shell(session, ["scope home\n", "get wifi password\n", "what\n", "quit\n", "get wifi\n"], out)
    assert out.getvalue() == "hunter2\nno such verb: what\n"
    out = io.StringIO()
    requests = [{"id": 1, "method": "tools/list"}, {"id": 2, "method": "tools/call", "params": {"name": "recall_value", "arguments": {"scope": "home", "text": "wifi password"}}}, {"id": 3, "method": "tools/call", "params": {"name": "x"}}, {"method": "notifications/initialized"}]
    wire.serve_tools(session, [json.dumps(r) for r in requests] + ["not json"], out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert {t["name"] for t in got[0]["result"]["tools"]} == set(wire.TOOLS) and got[1]["result"]["content"][0]["text"] == "hunter2"
    assert got[2]["error"]["code"] == -32602 and got[3]["error"]["code"] == -32700 and len(got) == 4
    assert {v for v, _ in wire.TOOLS.values()} <= set(VERBS)


def test_http(session):
    server = http.server(session, "127.0.0.1:0", "sesame")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"
    try:
        assert json.load(urllib.request.urlopen(f"{base}/healthz")) == {"ok": True}
        ask = lambda path, data=None: urllib.request.urlopen(urllib.request.Request(base + path, data, {"authorization": "Bearer sesame"}))
        assert json.load(ask("/v1/get?scope=home&text=wifi+password")) == "hunter2"
        assert json.load(ask("/recall_many", json.dumps({"scope": "home", "text": "wifi password", "k": 1}).encode()))[0]["value"] == "hunter2"
        for path, data, headers, status in (("/v1/get?scope=home", None, {}, 401), ("/v1/none", None, {"authorization": "Bearer sesame"}, 404), ("/v1/get", b"{", {"authorization": "Bearer sesame"}, 400), ("/v1/get", b" " * (http.MOST_BODY + 1), {"authorization": "Bearer sesame"}, 413)):
            assert http.answer(session, "GET", path, headers, data or b"", "sesame")[0] == status
    finally:
        server.shutdown()
