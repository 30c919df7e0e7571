"""Prompts, callbacks, cases, reports, sources, the runner and the stream."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import callbacks as U
from corpusmill.operators import dedup as D
from corpusmill.operators import phone as PH
from corpusmill.operators import prompts as R
from corpusmill.operators import report as A
from corpusmill.operators.checks import Check
from corpusmill.plans.components import components
from corpusmill.plans.runner import Generator
from corpusmill.sources import completion as C
from corpusmill.sources import jsonl
from corpusmill.sources.config import ApiConfig, Project, Rule, SamplingConfig, load_project, project_of


def test_components_of_paths_rings_and_hubs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 180)] + [(300, 300), (None, 1), (7, 7), (200, 201), (201, 202), (202, 200), (5, None)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["label"] for r in components(df.repartition(7)).collect()}
    assert {n: 0 for n in range(51)}.items() <= got.items() and {n: 100 for n in range(100, 180)}.items() <= got.items()
    assert got[202] == 200 and 300 not in got
    assert components(df.limit(0)).count() == 0


def test_a_task_hands_on_its_forest_in_chunks(monkeypatch):
    import pyarrow as pa

    from corpusmill.plans import components as module

    monkeypatch.setattr(module, "HELD", 10)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 6)), pa.array(range(i + 1, i + 7))], names=["a", "b"]) for i in range(0, 60, 6)]
    out = [pair for b in module._forest(iter(batches)) for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in out:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {root(i) for i in range(61)} == {0} and len(out) >= 60


def test_prompts(spark):
    assert R.plan_size(10, 4, 9, 9, 9) == 3 and R.plan_size(0, 4, 9, 9, 9) == 1 and R.plan_size(10, 4, 4, 2, 9) == 2 and R.plan_size(10, 4, 0, 2, 9) == 0
    asked = R.plan_requests(spark, "r", 5, 2)
    rows = R.sample_diversity(asked, [("a", ["1", "2", "3"], 2), ("b", ["x"], 5), ("c", ["y"], 0), ("d", [], 1)])
    got = {r["request_index"]: r["diversity"] for r in rows.collect()}
    assert sorted(got) == [6, 7] and [e["key"] for e in got[6]] == ["a", "b"] and len(set(got[6][0]["values"])) == 2
    assert {r["request_index"]: r["diversity"] for r in R.sample_diversity(asked, [("a", ["1", "2", "3"], 2), ("b", ["x"], 5)]).collect()} == got
    user = R.render_user_prompt("{rule_id} {{x}} {checks}|{diversity}|{output_contract}\n", "r", "g", 2, [], [], [Check("no_digits")], " go ", F.col("diversity"))
    text = rows.select(user.alias("u")).first()["u"]
    assert text.startswith("r {x} - must not contain decimal digits|- a: ") and text.endswith("|go")
    assert R.sample_diversity(asked, []).select(R.render_user_prompt("{diversity}", "r", "", 1, [], [], [], "", F.col("diversity")).alias("u")).first()["u"] == "- none"
    with pytest.raises(KeyError):
        R.render_user_prompt("{nope}", "r", "", 1, [], [], [], "", F.col("diversity"))


def test_callbacks(spark, tmp_path):
    file = tmp_path / "hooks.py"
    file.write_text("SEEN = 1\ndef pre(p):\n    return p + '!', 'a1'\ndef other(p):\n    return p, 'a2'\ndef bad(p):\n    return 5\ndef post(t, anchor=None):\n    if t == 'boom':\n        raise ValueError(t)\n    return (t != 'no', '' if t == 'no' else 'x')\nnothing = 3\n")
    spec = lambda f: U.CallbackSpec(str(file), f)
    with pytest.raises(FileNotFoundError):
        U.load(U.CallbackSpec(str(file) + "x", "pre"))
    with pytest.raises(AttributeError):
        U.load(spec("missing"))
    with pytest.raises(TypeError):
        U.load(spec("nothing"))
    assert U.load(spec("pre")).__globals__ is not U.load(spec("post")).__globals__
    df = spark.createDataFrame([(1, "p")], "request_index int, user_prompt string")
    row = U.with_extended_prompt(df, [U.load(spec("pre"))]).first()
    assert row["user_prompt_after_callbacks"] == "p!" and row["callback_anchor"] == "a1"
    assert U.with_extended_prompt(df, []).first()["callback_anchor"] is None
    for wrong in (["pre", "other"], ["bad"]):
        with pytest.raises(TypeError):
            U.extend_prompt([U.load(spec(f)) for f in wrong])("p")
    texts = spark.createDataFrame([("yes",), ("no",), ("boom",), (None,)], "t string")
    got = [tuple(r["v"]) for r in texts.select(U.post_validation([U.load(spec("post"))], F.col("t"), F.lit("a")).alias("v")).collect()]
    assert got[0] == (True, None, None) and got[1][1] == "post_validation:post_validation_rejected" and got[2][1] == U.ERROR and "boom" in got[2][2] and got[3][0] is True


def test_phone_cases(spark):
    numbers = PH.phone_numbers(spark, 300)
    rows = PH.expand_variants(numbers).collect()
    assert len(rows) == 3300 and len({r["case_id"] for r in rows}) == 3300 and len({r["phone_digits"] for r in rows}) == 300
    for r in rows:
        assert r["phone_digits"].startswith("8") and len(r["phone_digits"]) == 11 and [len(b) for b in r["blocks"]] == [1, 3, 3, 2, 2] and r["spoken"]
        assert (r["expected_result"] is None) == (r["kind"] == "incomplete")
    again = PH.expand_variants(PH.phone_numbers(spark, 300)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    with pytest.raises(ValueError):
        PH.phone_numbers(spark, 1, 5, 4)
    with pytest.raises(ValueError):
        PH.phone_numbers(spark, 10**8 * 3)
    asked, cases = spark.createDataFrame([(i * 3,) for i in range(7)], "r long"), spark.createDataFrame([(i * 5, f"c{i}") for i in range(3)], "v long, name string")
    got = sorted((r["r"], r["use_index"], r["name"]) for r in PH.assign_cyclically(asked, cases, "r", "v", 1).collect())
    assert got == [(i * 3, i + 1, f"c{(i + 1) % 3}") for i in range(7)]
    assert PH.assign_cyclically(asked, cases.limit(0), "r", "v").count() == 0


def test_report(spark):
    rows = spark.createDataFrame([("r", 1, None), ("r", 2, "a"), ("r", 3, "a"), ("r", 4, "b"), ("s", 1, None)], "rule_id string, seq long, reason string")
    rules = spark.createDataFrame([("r", 1), ("s", 5), ("t", 2)], "rule_id string, target int")
    counts = A.counts_by_reason(rows)
    assert sorted(map(tuple, counts.collect())) == [("r", "a", 2), ("r", "b", 1)]
    assert A.reasons_map(counts).first()["rejected"] == {"a": 2, "b": 1}
    per = A.accepted_and_remaining(rows, rules, F.col("reason").isNull())
    assert sorted(map(tuple, per.collect())) == [("r", 1, 1, 0), ("s", 5, 1, 4), ("t", 2, 0, 2)]
    assert tuple(A.totals(per).first()) == (8, 2, 6) and tuple(A.totals(per.limit(0)).first()) == (0, 0, 0)
    assert [r["seq"] for r in A.first_samples(rows.where("reason IS NOT NULL"), 2).orderBy("n").collect()] == [2, 3]
    assert A.run_status(["done", "done"]) == "done" and A.run_status(["done", "running"]) == "finished_with_incomplete_rules" and A.run_status([], True) == "failed"


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "a.jsonl")
    assert jsonl.read_tolerant(spark, path, "text string, n int").count() == 0 and jsonl.count_rows(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        jsonl.read_strict(spark, path, "text string")
    (tmp_path / "a.jsonl").write_text('{"text": "a", "n": 1}\n\n \nnot json\n[1]\n{"text": null, "n": "x"}\n{"n": 2, "more": 1}\n', encoding="utf-8")
    rows = jsonl.read_tolerant(spark, path, "text string, n int").collect()
    assert [(r["text"], r["n"]) for r in rows] == [("a", 1), (None, None), (None, 2)] and jsonl.count_rows(spark, path) == 5
    with pytest.raises(Exception):
        jsonl.read_strict(spark, path, "text string, n int").collect()
    out = str(tmp_path / "out")
    jsonl.write_lines(spark.createDataFrame([("r", None), ("s", "x")], "rule string, text string"), out, "append", ["rule"])
    assert (tmp_path / "out" / "rule=r").exists() and jsonl.read_tolerant(spark, out, "text string").count() == 2
    jsonl.truncate(spark, out)
    assert not (tmp_path / "out").exists()
    for n in (1, 2):
        jsonl.write_report(spark, {"n": n}, str(tmp_path / "deep" / "report.json"))
    assert json.loads((tmp_path / "deep" / "report.json").read_text()) == {"n": 2}


def test_requests_and_replies():
    api = ApiConfig("http://h/v1/", "m", "/chat", api_key="k", headers={"X": "1"})
    body = C.request_body(api, SamplingConfig(stop=["a"], presence_penalty=0.5, extra_body={"model": "z"}), "s", "u")
    assert body["model"] == "z" and body["stop"] == ["a"] and body["presence_penalty"] == 0.5 and "frequency_penalty" not in body
    assert C.url(api) == "http://h/v1/chat" and C.headers(api)["Authorization"] == "Bearer k" and C.headers(api)["X"] == "1"
    assert C.reply_text({"choices": [{"message": {"content": "a"}, "text": "b"}]}) == "a" and C.reply_text({"choices": [{"text": "b"}]}) == "b"
    with pytest.raises(ValueError):
        C.reply_text({"choices": []})


class _Server(http.server.BaseHTTPRequestHandler):
    calls = 0

    def do_POST(self):
        _Server.calls += 1
        self.rfile.read(int(self.headers["Content-Length"]))
        ok = _Server.calls > 1
        data = json.dumps({"choices": [{"message": {"content": "hi"}}]}).encode() if ok else b"{}"
        self.send_response(200 if ok else 500)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


def test_http_completer_retries():
    server = http.server.HTTPServer(("127.0.0.1", 0), _Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    api = ApiConfig(f"http://127.0.0.1:{server.server_port}", "m", retry_sleep_sec=0.01, max_retries=2)
    assert C.http_completer(api, SamplingConfig())("s", "u") == "hi" and _Server.calls == 2
    server.shutdown()
    with pytest.raises(RuntimeError):
        C.http_completer(ApiConfig("http://127.0.0.1:9", "m", retry_sleep_sec=0.01, max_retries=1, timeout_sec=1), SamplingConfig())("s", "u")


CONFIG = """
run: {name: demo, prompts_per_cycle: 2, resume: true, max_consecutive_empty_cycles: 2}
api: {base_url: "http://x", model: m, concurrency: 2}
output: {root_dir: out}
parser: {type: json_array}
diversity_profiles: {d: {dimensions: {tone: [a, b]}, sample: {tone: 1}}}
dedup_profiles: {loose: {prefix_limit: {enabled: false}, ngram_similarity: {enabled: false}}}
rules:
  - {id: one, count: 6, batch_size: 3, goal: g, diversity_profile: d, dedup_profile: loose, checks: [{type: no_digits}]}
  - {id: two, count: 3, batch_size: 3, goal: g, dedup_profile: loose}
"""


def _answer(system: str, user: str) -> str:
    import hashlib

    n = int(hashlib.md5(user.encode()).hexdigest(), 16) % 7
    return json.dumps(["same text", "has 1 digit", f"text {'abcdefg'[n]} x", f"text {'abcdefg'[n]} y", f"one more {'abcdefg'[n]}"])


def test_generation_run_and_resume(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG)
    project = load_project(str(tmp_path / "c.yaml"))
    assert isinstance(project, Project) and project.rules[0].checks[0].type == "no_digits"
    report = Generator(spark, project, completer=_answer).run()
    one = report["rules"]["one"]
    assert one["accepted"] <= 6 and one["rejected"].get("no_digits:digits_present", 0) > 0 and report["rules"]["two"]["status"] == "done"
    saved = json.loads((tmp_path / "out" / "report.json").read_text())
    assert saved["totals"]["accepted"] == report["totals"]["accepted"]
    gen = Generator(spark, project, completer=_answer)
    rows = gen._accepted()
    texts = [r["text"] for r in rows.where("rule_id = 'one'").collect()]
    assert len(texts) == one["accepted"] == len(set(texts)) and all(not any(c.isdigit() for c in t) for t in texts)
    assert rows.where("rule_id = 'one'").first()["meta"]["diversity"]["tone"][0] in "ab"
    again = gen.run()
    assert again["rules"]["two"]["api_requests"] == 0 and gen.dataset().count() == gen._accepted().count() == again["totals"]["accepted"]
    assert (tmp_path / "out" / "per_rule" / "two.jsonl").exists() and gen._accepted().where("rule_id = 'two'").count() == 3


def test_failures_are_in_the_report_while_it_runs(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(CONFIG.replace("resume: true", "resume: false"))
    project = load_project(str(tmp_path / "c.yaml"))
    seen = []

    def requests(prompts):
        seen.append(json.loads((tmp_path / "out" / "report.json").read_text()))
        reply = F.when(F.col("request_index") % 2 == 1, F.lit("no array"))
        return prompts.select("rule_id", F.col("request_index").cast("int"), reply.alias("raw_text"), F.when(reply.isNull(), "boom").alias("error"))

    report = Generator(spark, project, requests=requests).run()
    one = report["rules"]["one"]
    assert seen[0]["status"] == "running" and seen[1]["rules"]["one"]["api_requests"] == 2 and seen[1]["updated_at_unix"]
    assert one["errors"] == {"api_error": 2} and one["rejected"] == {"parse_error": 2} and one["status"] == "empty_cycle_limit_reached"
    assert {s["reason"]: s.get("raw_text") or s["error"] for s in one["rejection_samples"]} == {"api_error": "boom", "parse_error": "no array"}
    assert report["status"] == "finished_with_incomplete_rules" and report["totals"]["accepted"] == 0


def test_case_file(tmp_path, monkeypatch, spark):
    from corpusmill.__main__ import build_cases, path_from

    monkeypatch.setenv("CASES", str(tmp_path / "cases"))
    assert build_cases(["--count", "3", "--output-env", "CASES"]) == 33
    rows = jsonl.read_strict(spark, path_from("CASES"), "case_id string, blocks array<string>, expected_result string").collect()
    assert len({r["case_id"] for r in rows}) == 33 and sum(r["expected_result"] is None for r in rows) == 15
    with pytest.raises(RuntimeError):
        path_from("NO_SUCH_NAME")


def test_configuration_errors(tmp_path):
    with pytest.raises(TypeError):
        project_of([], tmp_path)
    with pytest.raises(ValueError):
        project_of({"rules": [{"id": "a b", "count": 1}]}, tmp_path)
    with pytest.raises(ValueError):
        project_of({"rules": [{"id": "a", "count": 1}, {"id": "a", "count": 2}]}, tmp_path)
    p = project_of({"rules": [{"id": "a", "count": 1, "dedup_profile": "none", "diversity_profile": "none"}], "unknown": 1}, tmp_path)
    with pytest.raises(ValueError):
        p.policy(p.rules[0])
    with pytest.raises(ValueError):
        p.dimensions(p.rules[0])
    assert p.dedup["smart_text"] == D.DedupPolicy() and isinstance(p.rules[0], Rule)


def test_stream_equals_batch(spark, tmp_path):
    from corpusmill.streaming.dedup_stream import dedup_stream

    from .test_dedup import sequential, stream

    policy = D.DedupPolicy("s", prefix_words=2, prefix_max=4, threshold=0.7, max_compare=5)
    rows = stream(11, 60)
    want = sequential(rows, policy)
    got = {}
    source, check, sink = str(tmp_path / "in"), str(tmp_path / "check"), str(tmp_path / "out")
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, "rule_id string, seq long, text string").coalesce(1).write.mode("append").parquet(source)
        query = dedup_stream(spark.readStream.schema("rule_id string, seq long, text string").parquet(source), policy)
        run = query.writeStream.format("parquet").option("path", sink).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination(120)
    for r in spark.read.parquet(sink).collect():
        got[r["rule_id"], r["seq"]] = r["verdict"]
    assert got == want
