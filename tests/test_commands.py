"""The command line, and an endpoint over HTTP."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from kilnwork.__main__ import main
from kilnwork.functions import jsontext as J
from kilnwork.operators.endpoint import chat_client
from kilnwork.plans import adapters
from kilnwork.sources import io


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "processed")
    spark.range(160).select(F.col("id").alias("p_partkey"), F.lit("blue tin").alias("p_name"), F.lit("Brand#1").alias("p_brand"), F.lit(3).alias("p_size")).createOrReplaceTempView("kilnwork_part")
    io.save_dataset(spark.sql(adapters.A_PROCESSED.replace("FROM part", "FROM kilnwork_part")), path)
    return path


class Chat(BaseHTTPRequestHandler):
    asked: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Chat.asked.append((self.path, self.headers.get("Authorization"), body))
        tools = J.load_tools(json.dumps(json.loads(body["messages"][1]["content"])["tools"]))
        tool = J.function_names(tools)[0]
        text = json.dumps({"success": [{"request": "r", "tool": tool, "call": f"[{tool}()]"}], "failed": [], "description": "d"})
        reply = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
        self.send_response(500 if len(Chat.asked) % 9 == 1 else 200)
        self.end_headers()
        self.wfile.write(reply)

    def log_message(self, *args):
        pass


@pytest.fixture
def endpoint():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Chat.asked.clear()
    yield f"http://127.0.0.1:{server.server_port}/v1"
    server.shutdown()


def test_annotate_over_http_and_resume(spark, table, tmp_path, endpoint, monkeypatch):
    monkeypatch.setenv("SOME_KEY", "k1")
    out = str(tmp_path / "out")
    common = ["annotate", "--source", table, "--output", out, "--base-url", endpoint, "--model", "m", "--key-variable", "SOME_KEY", "--flush-every", "8"]
    first = main([*common, "--limit", "10", "--tries", "4"], spark)
    assert first["planned"] == 10 and first["buckets"] == {"valid": 10} and first["parts"] == 2
    path, key, body = Chat.asked[0]
    assert path == "/v1/chat/completions" and key == "Bearer k1" and body["model"] == "m" and body["temperature"] == 0.0 and body["max_tokens"] == 2048
    with pytest.raises(SystemExit, match="resume"):
        main(common, spark)
    second = main([*common, "--resume", "--tries", "4", "--metadata", str(tmp_path / "m.json")], spark)
    assert second["buckets"] == {"valid": second["planned"]} and second["planned"] > 10 and json.loads((tmp_path / "m.json").read_text()) == second
    saved = io.read_dataset(spark, f"{out}/dataset")
    assert saved.count() == second["planned"] and len(saved.columns) == 13
    n = len(Chat.asked)
    main([*common, "--resume"], spark)
    assert len(Chat.asked) == n
    assert chat_client(endpoint, "m")(Chat.asked[0][2]["messages"]).startswith("{")


def test_dry_run_and_missing_endpoint(spark, table, tmp_path):
    with pytest.raises(SystemExit, match="endpoint"):
        main(["annotate", "--source", table, "--output", str(tmp_path / "a")], spark)
    got = main(["annotate", "--source", table, "--output", str(tmp_path / "b"), "--dry-run"], spark)
    assert got["buckets"] == {"dry_run": got["planned"]}


def test_structure_perturb_shuffle_retokenize(spark, table, tmp_path):
    turn = lambda who, text: F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), F.lit(who).alias("from"), text.alias("value"))
    turns = F.array(turn("user", F.concat(F.lit("Hi "), F.repeat(F.lit("w "), F.col("id").cast("int")))), turn("assistant", F.lit("[f(a=1)]")))
    raw = spark.range(30).select(F.col("id").alias("key"), F.lit("Answer.").alias("system"), turns.alias("conversations"))
    io.save_dataset(raw, str(tmp_path / "raw"))
    (tmp_path / "c.json").write_text(json.dumps({"active_profile": "p", "profiles": {"p": {"structure": {"max-seq-length": 40}}}}))
    got = main(["structure", "--source", str(tmp_path / "raw"), "--output", str(tmp_path / "s"), "--config", str(tmp_path / "c.json")], spark)
    kept = io.read_dataset(spark, str(tmp_path / "s"))
    assert got["rows_before"] == 30 and got["rows_after"] == kept.count() < 30 and kept.agg(F.max("prompt_token_length")).first()[0] <= 40
    got = main(["perturb", "--source", table, "--output", str(tmp_path / "p"), "--train-share", "0.5"], spark)
    assert got["train"]["rows"] + got["test"]["rows"] == 160 and got["train"]["flagged"] > 0
    got = main(["shuffle", "--source", str(tmp_path / "p" / "train"), "--output", str(tmp_path / "q"), "--ratio", "0.1"], spark)
    assert got["rows"]["flagged"] == round(io.read_dataset(spark, str(tmp_path / "p" / "train")).count() * 0.1)
    with pytest.raises(SystemExit, match="exists"):
        main(["shuffle", "--source", table, "--output", str(tmp_path / "q")], spark)
    got = main(["retokenize", "--source", str(tmp_path / "q"), "--output", str(tmp_path / "t"), "--max-seq-length", "300"], spark)
    one = io.read_dataset(spark, str(tmp_path / "t")).first()
    assert got["rows"]["rows"] > 0 and len(one.input_ids) == len(one.labels) == 300
