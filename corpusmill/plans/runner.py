"""The generation loop: plan requests, complete them, judge the candidates, append what is accepted, report.

One cycle is one Spark plan that is written once; all counters come from the written table. Accepted rows are the only
state, so a run that was stopped goes on from its output folder: request numbers continue after the last used one.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators import callbacks as U
from ..operators import prompts as R
from ..operators.report import counts_by_reason, first_samples, rule_status, run_status
from ..sources import jsonl
from ..sources.completion import Completer, complete, http_completer
from ..sources.config import Project, Rule
from . import verdicts as V
from .scratch import cut

LOG = logging.getLogger(__name__)
RECORD = (
    "rule_id string, text string, meta struct<run_name:string,source:string,model:string,accepted_at_unix:double,request_index:int,candidate_index:int,parser:string,"
    "diversity:map<string,array<string>>,callback_anchor:string,callbacks:struct<pre_extension:array<struct<path:string,function:string>>,post_validation:array<struct<path:string,function:string>>>>"
)


class Generator:
    def __init__(self, spark: SparkSession, project: Project, completer: Completer | None = None, requests: Callable[[DataFrame], DataFrame] | None = None):
        """``completer`` replaces the HTTP source; ``requests`` may replace the completion step as a whole (e.g. a replay)."""
        self.spark, self.project = spark, project
        self.completer = completer or http_completer(project.api, project.sampling)
        self.requests = requests or (lambda p: complete(p, self.completer, project.api.concurrency))
        self.folder = project.output.root_dir
        self.data = f"{self.folder}/{project.output.per_rule_dir}"
        self.rules: dict[str, dict] = {}
        self.started = time.time()

    def _rule_path(self, rule_id: str) -> str:
        return f"{self.data}/{rule_id}.jsonl"

    def _accepted(self) -> DataFrame:
        """Accepted rows of the project's rules; rows of rules that it has no more are not read."""
        rows = jsonl.read_tolerant(self.spark, [self._rule_path(r.id) for r in self.project.rules], RECORD)
        return rows.where(strip(F.col("text")) != "")

    def _prior(self, rule: Rule) -> DataFrame:
        """Earlier accepted rows that share the rule's bucket, of all rules for a global one."""
        rows = self._accepted().select("rule_id", "text", F.coalesce("meta.request_index", F.lit(0)).alias("request_index"), F.coalesce("meta.candidate_index", F.lit(0)).alias("candidate_index"))
        order = F.coalesce(F.element_at(F.create_map(*(x for i, r in enumerate(self.project.rules) for x in (F.lit(r.id), F.lit(i)))), F.col("rule_id")), F.lit(0))
        rows = V.with_seq(rows).withColumn("seq", F.col("seq") + order.cast("long") * F.lit(1 << 50))
        same = [r.id for r in self.project.rules if r.dedup_profile == rule.dedup_profile] if self.project.policy(rule).scope == "global" else [rule.id]
        return rows.where(F.col("rule_id").isin(same)).select("rule_id", "text", "seq")

    def prompts(self, rule: Rule, start: int, count: int) -> DataFrame:
        p = self.project
        sampled = R.sample_diversity(R.plan_requests(self.spark, rule.id, start, count), p.dimensions(rule), p.run.random_seed)
        user = R.render_user_prompt(p.user_template, rule.id, rule.goal, rule.batch_size, list(rule.positive), list(rule.negative), list(rule.checks), p.output_contract, F.col("diversity"))
        rows = sampled.withColumn("system", F.lit(p.system_template.strip())).withColumn("user_prompt", user)
        functions = [U.load(s) for s in (*p.pre_extension, *rule.pre_extension)]
        return U.with_extended_prompt(rows, functions)

    def _run_rule(self, rule: Rule) -> None:
        p, run = self.project, self.project.run
        post = [U.load(s) for s in (*p.post_validation, *rule.post_validation)]
        policy = p.policy(rule)
        done = self._accepted().where(F.col("rule_id") == rule.id).agg(F.count("*").alias("n"), F.max("meta.request_index").alias("last")).first()
        state = self.rules[rule.id] = {"rule_id": rule.id, "target": rule.count, "accepted": done["n"], "api_requests": 0, "parsed_candidates": 0, "rejected": {}, "errors": {}, "rejection_samples": [], "started_at_unix": time.time()}
        state["status"] = "running"
        self._touch()
        start, empty = done["last"] or 0, 0
        while state["accepted"] < rule.count and state["api_requests"] < run.max_requests_per_rule and empty < run.max_consecutive_empty_cycles:
            count = R.plan_size(rule.count - state["accepted"], rule.batch_size, run.prompts_per_cycle, p.api.concurrency, run.max_requests_per_rule - state["api_requests"])
            if count <= 0:
                state["errors"]["no_prompt_requests"] = 1
                break
            got = self._cycle(rule, policy, post, start, count, state)
            start += count
            state["api_requests"] += count
            state["updated_at_unix"] = time.time()
            self._touch()
            empty = 0 if got else empty + 1
        limits = (F.lit(state["accepted"]), F.lit(rule.count), F.lit(state["api_requests"]), run.max_requests_per_rule, F.lit(empty), run.max_consecutive_empty_cycles)
        state["status"] = self.spark.range(1).select(rule_status(*limits).alias("s")).first()["s"]
        if "no_prompt_requests" in state["errors"]:
            state["status"] = "request_limit_reached"
        state["finished_at_unix"] = state["updated_at_unix"] = time.time()
        self._touch()

    def _cycle(self, rule: Rule, policy, post, start: int, count: int, state: dict) -> int:
        p = self.project
        prompts = cut(self.prompts(rule, start, count), "prompts")
        replies = cut(self.requests(prompts.select("rule_id", "request_index", "system", F.col("user_prompt_after_callbacks").alias("user"))), "replies")
        items = cut(V.parsed(replies.where("raw_text IS NOT NULL"), p.parser), "items")
        candidates = V.P.explode_candidates(items.where("items IS NOT NULL").select("rule_id", "request_index", "items")).join(prompts.select("request_index", "callback_anchor", "diversity"), "request_index")
        rows = cut(V.judged(candidates, list(rule.checks), post, policy, rule.count, self._prior(rule), state["accepted"]), "verdicts")
        specs = (*p.pre_extension, *rule.pre_extension), (*p.post_validation, *rule.post_validation)
        accepted = V.accepted_records(rows.where("stage = 'ok'"), p.run.name, p.api.model, p.parser, *specs, time.time())
        accepted = cut(accepted, "accepted")
        jsonl.write_lines(accepted, self._rule_path(rule.id), "append")
        jsonl.write_lines(accepted, f"{self.folder}/{p.output.dataset_filename}", "append")
        lost = replies.where("raw_text IS NULL")
        failed = lost.count()
        broken = items.where("items IS NULL")
        counts = {r["reason"]: r["n"] for r in counts_by_reason(rows).collect()}  # a row for each reason
        if n := broken.count():
            counts["parse_error"] = n
        if failed:
            state["errors"]["api_error"] = state["errors"].get("api_error", 0) + failed
        if n := counts.get(U.ERROR):
            state["errors"][U.ERROR] = state["errors"].get(U.ERROR, 0) + n
        for reason, n in counts.items():
            state["rejected"][reason] = state["rejected"].get(reason, 0) + n
        samples = state["rejection_samples"]
        room = lambda: p.output.rejection_sample_limit_per_rule - len(samples)
        if failed and room() > 0:
            samples += [{"reason": "api_error", "error": r["error"]} for r in lost.orderBy("request_index").limit(room()).collect()]
        if counts.get("parse_error") and room() > 0:
            samples += [{"reason": "parse_error", "error": f"not a reply for the parser {p.parser}", "raw_text": r["raw_text"]} for r in broken.orderBy("request_index").limit(room()).collect()]
        if room() > 0:
            shown = first_samples(rows.where("reason IS NOT NULL"), room()).orderBy("n").select("reason", "text", "error")
            samples += [{k: v for k, v in r.asDict().items() if k != "error" or v is not None} for r in shown.collect()]
        state["parsed_candidates"] += items.agg(F.coalesce(F.sum(F.size("items")), F.lit(0))).first()[0]
        got = rows.where("stage = 'ok'").count()
        state["accepted"] += got
        LOG.info("%s: accepted %d of %d, rejected %d, errors %d, requests %d", rule.id, state["accepted"], rule.count, sum(state["rejected"].values()), sum(state["errors"].values()), start + count)
        return got

    def run(self) -> dict:
        """Process all rules in order; returns the report, which is written after each cycle."""
        if not self.project.run.resume:
            for rule in self.project.rules:
                jsonl.truncate(self.spark, self._rule_path(rule.id))
            jsonl.truncate(self.spark, f"{self.folder}/{self.project.output.dataset_filename}")
        self.started = time.time()
        self._touch()
        try:
            for rule in self.project.rules:
                self._run_rule(rule)
        except Exception as e:
            self._touch("failed", f"{type(e).__name__}: {e}")
            raise
        return self._touch(run_status([r["status"] for r in self.rules.values()]))

    def dataset(self) -> DataFrame:
        """All accepted records that the dataset folder holds."""
        return jsonl.read_tolerant(self.spark, f"{self.folder}/{self.project.output.dataset_filename}", RECORD)

    def _touch(self, status: str = "running", error: str | None = None) -> dict:
        report = self.report(status, error)
        jsonl.write_report(self.spark, report, f"{self.folder}/{self.project.output.report_filename}")
        return report

    def report(self, status: str = "running", error: str | None = None) -> dict:
        """The state of the run, at any time."""
        now = time.time()
        rules = {k: {"rule_id": k, "status": "pending"} | r | {"remaining": max(r["target"] - r["accepted"], 0)} for k, r in self.rules.items()}
        total = {k: sum(r[k] for r in rules.values()) for k in ("target", "accepted")}
        out = {"run_name": self.project.run.name, "status": status, "model": self.project.api.model, "started_at_unix": self.started, "updated_at_unix": now, "finished_at_unix": None if status == "running" else now}
        out |= {"totals": total | {"remaining": max(total["target"] - total["accepted"], 0)}, "rules": rules}
        return out | ({"fatal_error": error} if error else {})
