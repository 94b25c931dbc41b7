"""Run contracts, promotion gates and leakage policies; small driver-side checks."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from pathlib import Path
from typing import Any

from ..files import member, read_json

_SHA = re.compile(r"[0-9a-f]{64}")


@dataclass(frozen=True)
class RunContract:
    """What a retrieval run was made with. Two runs can be compared only if all but the system agree."""

    system_id: str
    track: str
    split: str
    corpus_sha256: str
    claims_sha256: str
    qrels_sha256: str
    split_sha256: str
    config_sha256: str
    candidate_width: int
    final_k: int

    def check(self) -> RunContract:
        if not self.system_id or not self.split or not self.track:
            raise ValueError("system, track and split are needed")
        for name, value in asdict(self).items():
            if name.endswith("sha256") and not _SHA.fullmatch(value):
                raise ValueError(f"{name} must be 64 lower-case hex digits")
        if self.candidate_width < 10 or not 5 <= self.final_k <= self.candidate_width:
            raise ValueError("candidate_width must be 10 or more and final_k between 5 and it")
        return self


    @classmethod
    def load(cls, path: str | Path) -> RunContract:
        """A checked contract from a JSON file; unknown fields are left out, missing ones an error."""
        found = read_json(path)
        names = [f.name for f in fields(cls)]
        if missing := [n for n in names if n not in found]:
            raise ValueError(f"contract lacks {missing}")
        return cls(**{n: int(found[n]) if n in ("candidate_width", "final_k") else str(found[n]) for n in names}).check()


def mismatches(base: RunContract, candidate: RunContract) -> list[str]:
    """Names of fields that keep two runs from being compared."""
    own = {"system_id", "config_sha256"}
    out = [n for n, v in asdict(base).items() if n not in own and v != getattr(candidate, n)]
    return out + (["system_id"] if base.system_id == candidate.system_id else [])


def promoted(deltas: dict[str, dict[str, float]], *, strict_mean: bool = True) -> bool:
    """The primary metric's interval lies above 0 (its mean too, if strict) and no secondary mean is negative."""
    main = deltas["recall@5"]
    low = main.get("ci_lower", main.get("lower"))
    ok = low is not None and low > 0 and (main["mean_difference"] > 0 or not strict_mean)
    return ok and all(d["mean_difference"] >= 0 for n, d in deltas.items() if n != "recall@5")


def advance(pilots: dict[str, dict[str, float]], most: int = 2) -> tuple[list[str], str | None]:
    """Pilots with a better primary and no worse secondary metric, best first; with none, the best one as a diagnostic."""
    order = sorted(pilots, key=lambda p: (-pilots[p]["recall@5"], -pilots[p].get("ndcg@10", 0.0), p))
    good = [p for p in order if pilots[p]["recall@5"] > 0 and all(v >= 0 for n, v in pilots[p].items() if n != "recall@5")]
    return good[:most], (None if good or not order else order[0])


def may_use_test(split: str, consumed_by: str | None, system_id: str, *, exact_reproduction: bool = False) -> None:
    """A frozen test split is used once; afterwards only an exact reproduction of the same system may."""
    if split != "test" or consumed_by is None:
        return
    if not (exact_reproduction and consumed_by == system_id):
        raise PermissionError(f"the test split was consumed by {consumed_by}")


# Metrics that gates look at, the deciding one first.
GATE_METRICS = ("recall@5", "mrr@10", "ndcg@10", "evidence_f1")


def screened(deltas: Mapping[str, Mapping[str, float]]) -> dict[str, Any]:
    """Whether a sampled run is worth a full one: the deciding metric's mean and lower bound are above 0."""
    d = deltas[GATE_METRICS[0]]
    return {"passed": d["mean_difference"] > 0 and d["ci_lower"] > 0, "mean_difference": d["mean_difference"], "ci_lower": d["ci_lower"]}


def choose_full(runs: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """Of at most two full runs, the best promoted one; with none promoted, the best, kept for analysis only."""
    if len(runs) > 2:
        raise ValueError("at most two full runs")
    order = sorted(runs, key=lambda r: (-runs[r]["candidate"]["recall@5"], -runs[r]["candidate"]["ndcg@10"], r))
    good = [r for r in order if promoted(runs[r]["paired_bootstrap"])]
    return {"full_result_count": len(runs), "promoted": good, "selected": (good or order or [None])[0], "selected_promoted": bool(good)}


def test_policy(path: str | Path, *, split: str, system_id: str, exact_reproduction: bool = False) -> str:
    """What a policy file says to a use of a split; a use that it forbids is an error."""
    frozen = member(read_json(path), "frozen_test")
    if split != "test":
        return "allowed_non_test_split"
    status = str(frozen.get("status"))
    if status == "unconsumed":
        return "allowed_unique_final_test"
    if status != "consumed" or not frozen.get("exact_baseline_reproduction_allowed", False):
        raise ValueError("the frozen test split is consumed")
    try:
        may_use_test(split, str(frozen.get("consumed_system_id", "")), system_id, exact_reproduction=exact_reproduction)
    except PermissionError as e:
        raise ValueError(str(e)) from e
    return "allowed_exact_consumed_baseline_reproduction"


def shares(counts: Mapping[str, float]) -> dict[str, float]:
    """Counts as shares of their sum; nothing for an empty or zero mapping, an error for a negative count."""
    if any(v < 0 for v in counts.values()):
        raise ValueError("counts must not be negative")
    total = sum(counts.values())
    return {k: v / total for k, v in counts.items()} if total > 0 else {}


def train_serve_audit(train: Mapping[str, Any], serve: Mapping[str, Any], *, limit: float = 0.15) -> dict[str, Any]:
    """Seven checks that a ranker is served what it was trained on; all must hold."""
    if not 0 <= limit <= 1:
        raise ValueError("limit must be within [0, 1]")
    a, b = (shares(x.get("candidate_source_distribution") or {}) for x in (train, serve))
    variation = sum(abs(a.get(k, 0.0) - b.get(k, 0.0)) for k in a.keys() | b.keys()) / 2
    width, names = int(train.get("candidate_width", 0)), list(train.get("feature_names", ()))
    handed = str(train.get("reachable_positive_id_sha256", ""))
    checks = {
        "candidate_width_equal": 0 < width == int(serve.get("candidate_width", 0)),
        "feature_names_equal": bool(names) and names == list(serve.get("feature_names", ())),
        "all_training_positives_reachable": float(train.get("reachable_positive_rate", 0)) == 1.0,
        "candidate_source_support_equal": a.keys() == b.keys(),
        "candidate_source_total_variation_within_limit": variation <= limit,
        "reachable_positive_handoff_exact": len(handed) == 64 and handed == str(serve.get("training_reachable_positive_id_sha256", "")),
        "positive_policy_equal": train.get("positive_policy") == serve.get("positive_policy") == "candidate-supported-only",
    }
    return {"status": "passed" if all(checks.values()) else "failed", "checks": checks, "total_variation": variation, "limit": limit}


def check_protocol(protocol: Mapping[str, Any], policy: Mapping[str, Any], expected: Mapping[str, Any]) -> None:
    """A protocol against its frozen values.

    ``expected`` maps dotted names to values that the protocol must have (after ``policy:``, the
    policy). Adapters must be as many as named by ``adapters`` with unique ids; every listed error is reported.
    """
    wrong = []
    for name, want in expected.items():
        if name == "adapters":
            ids = [str(a["id"]) for a in protocol.get("adapters", ())]
            if len(ids) != want or len(set(ids)) != len(ids):
                wrong.append(f"{want} adapters with unique ids")
            continue
        source, path = (policy, name.removeprefix("policy:")) if name.startswith("policy:") else (protocol, name)
        try:
            found = member(dict(source), *path.split("."))
        except TypeError:
            found = None
        if found != want:
            wrong.append(f"{name} must be {want!r}, not {found!r}")
    if wrong:
        raise ValueError("; ".join(wrong))
