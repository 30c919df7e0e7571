"""The project's YAML file as immutable objects on the driver. Unknown keys are ignored."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from pathlib import Path
from typing import Any

from ..operators.callbacks import CallbackSpec
from ..operators.checks import Check
from ..operators.dedup import DedupPolicy

RULE_ID = re.compile(r"[A-Za-z0-9_.-]+")
DEFAULT_SYSTEM = "You write natural texts for a dataset. Follow the requested output format exactly."
DEFAULT_USER = "Write {batch_size} texts for {rule_id}.\n\nGoal:\n{goal}\n\nGood examples:\n{positive_examples}\n\nBad examples:\n{negative_examples}\n\nChecks:\n{checks}\n\nContext:\n{diversity}\n\n{output_contract}"
DEFAULT_CONTRACT = "Return only a valid JSON array of strings."


@dataclass(frozen=True)
class RunConfig:
    name: str = "run"
    random_seed: int = 42
    resume: bool = True
    prompts_per_cycle: int = 4
    max_requests_per_rule: int = 10000
    max_consecutive_empty_cycles: int = 50


@dataclass(frozen=True)
class ApiConfig:
    base_url: str = ""
    model: str = ""
    endpoint: str = "/chat/completions"
    api_key_env: str | None = None
    api_key: str | None = None
    timeout_sec: float = 120.0
    max_retries: int = 3
    retry_sleep_sec: float = 2.0
    concurrency: int = 4
    headers: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class SamplingConfig:
    temperature: float = 0.9
    top_p: float = 0.9
    max_tokens: int = 512
    presence_penalty: float | None = None
    frequency_penalty: float | None = None
    stop: list[str] = field(default_factory=list)
    extra_body: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class OutputConfig:
    root_dir: str = "output"
    report_filename: str = "report.json"
    dataset_filename: str = "dataset.jsonl"
    per_rule_dir: str = "per_rule"
    rejection_sample_limit_per_rule: int = 100


@dataclass(frozen=True)
class DiversityProfile:
    dimensions: dict[str, list[str]] = field(default_factory=dict)
    sample: dict[str, int] = field(default_factory=dict)

    def rows(self) -> list[tuple[str, list[str], int]]:
        return [(d, [str(v) for v in values], int(self.sample.get(d, 0))) for d, values in self.dimensions.items()]


@dataclass(frozen=True)
class Rule:
    id: str
    count: int
    goal: str = ""
    batch_size: int = 10
    diversity_profile: str | None = None
    dedup_profile: str = "smart_text"
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    checks: tuple[Check, ...] = ()
    pre_extension: tuple[CallbackSpec, ...] = ()
    post_validation: tuple[CallbackSpec, ...] = ()


@dataclass(frozen=True)
class Project:
    run: RunConfig
    api: ApiConfig
    sampling: SamplingConfig
    output: OutputConfig
    parser: str
    system_template: str
    user_template: str
    output_contract: str
    diversity: dict[str, DiversityProfile]
    dedup: dict[str, DedupPolicy]
    pre_extension: tuple[CallbackSpec, ...]
    post_validation: tuple[CallbackSpec, ...]
    rules: tuple[Rule, ...]

    def policy(self, rule: Rule) -> DedupPolicy:
        if rule.dedup_profile not in self.dedup:
            raise ValueError(f"unknown dedup profile: {rule.dedup_profile}")
        return self.dedup[rule.dedup_profile]

    def dimensions(self, rule: Rule) -> list[tuple[str, list[str], int]]:
        if not rule.diversity_profile:
            return []
        if rule.diversity_profile not in self.diversity:
            raise ValueError(f"unknown diversity profile: {rule.diversity_profile}")
        return self.diversity[rule.diversity_profile].rows()


_CAST = {"int": int, "float": float, "str": str, "bool": bool}


def _typed(cls: type, entry: dict[str, Any] | None) -> Any:
    entry = entry or {}
    out = {}
    for f in fields(cls):
        if f.name in entry:
            value = entry[f.name]
            out[f.name] = _CAST[f.type](value) if f.type in _CAST and value is not None else value
    return cls(**out)


def _text(entry: dict[str, Any], name: str, default: str, base: Path) -> str:
    """A path beats the inline text, which beats the default."""
    path = entry.get(f"{name}_path")
    if path:
        return (base / str(path)).read_text(encoding="utf-8")
    return str(entry.get(name) or default)


def _specs(entries: list[dict[str, Any]] | None, base: Path) -> tuple[CallbackSpec, ...]:
    return tuple(CallbackSpec(str((base / str(e["path"])).resolve()), str(e["function"])) for e in entries or [])


def project_of(raw: Any, base: Path) -> Project:
    if not isinstance(raw, dict):
        raise TypeError("the configuration must be a mapping")
    prompts = raw.get("prompts") or raw.get("prompt_profile") or {}
    hooks = raw.get("callbacks") or {}
    rules: list[Rule] = []
    for r in raw.get("rules") or []:
        name = str(r["id"])
        if not RULE_ID.fullmatch(name):
            raise ValueError(f"rule id has other characters than letters, digits, _ . and -: {name}")
        if name in {x.id for x in rules}:
            raise ValueError(f"two rules have the id {name}")
        examples, own = r.get("examples") or {}, r.get("callbacks") or {}
        rules.append(Rule(
            name, int(r["count"]), str(r.get("goal", "")), int(r.get("batch_size", 10)), r.get("diversity_profile"), str(r.get("dedup_profile", "smart_text")),
            tuple(map(str, examples.get("positive") or [])), tuple(map(str, examples.get("negative") or [])), tuple(Check.of(c) for c in r.get("checks") or []),
            _specs(own.get("pre_extension"), base), _specs(own.get("post_validation"), base),
        ))
    dedup = {n: DedupPolicy.of(n, e) for n, e in (raw.get("dedup_profiles") or {}).items()}
    dedup.setdefault("smart_text", DedupPolicy())
    output = _typed(OutputConfig, raw.get("output"))
    output = OutputConfig(str((base / output.root_dir).resolve()), *(getattr(output, f.name) for f in fields(OutputConfig)[1:]))
    return Project(
        _typed(RunConfig, raw.get("run")), _typed(ApiConfig, raw.get("api")), _typed(SamplingConfig, raw.get("sampling")), output, str((raw.get("parser") or {}).get("type", "json_array")),
        _text(prompts, "system_template", DEFAULT_SYSTEM, base), _text(prompts, "user_template", DEFAULT_USER, base), _text(prompts, "output_contract_template", DEFAULT_CONTRACT, base),
        {n: DiversityProfile(e.get("dimensions") or {}, e.get("sample") or {}) for n, e in (raw.get("diversity_profiles") or {}).items()},
        dedup, _specs(hooks.get("pre_extension"), base), _specs(hooks.get("post_validation"), base), tuple(rules),
    )


def load_project(path: str) -> Project:
    """Relative paths in the file are read from its own folder."""
    import yaml

    file = Path(path).expanduser().resolve()
    return project_of(yaml.safe_load(file.read_text(encoding="utf-8")) or {}, file.parent)
