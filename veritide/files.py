"""Files on the driver: hashes, JSON, configurations, run folders, manifests and the transfer ledger.

Everything here is small and local to the driver. What grows with the data is hashed in a stream
(:func:`ordered_id_sha256`) or by executors (:func:`tree_sha256`).
"""

from __future__ import annotations

import hashlib
import json
import os
import platform
import re
import shutil
import subprocess
import time
import urllib.request
from collections.abc import Iterable
from datetime import datetime, timedelta, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of a job accounting row, in their order.
ACCOUNTING_FIELDS = (
    "job_id", "job_name", "partition", "allocated_tres", "requested_memory", "elapsed", "max_rss", "state", "exit_code",
)

_BLOCK = 1 << 20


# -- hashes ---------------------------------------------------------------------------------


def digest(path: str | Path, kind: str = "sha256") -> str:
    """Hash of a file's bytes, read in blocks."""
    h = hashlib.new(kind)
    with open(path, "rb") as f:
        while block := f.read(_BLOCK):
            h.update(block)
    return h.hexdigest()


def newline_sha256(path: str | Path, newline: str) -> str:
    """SHA-256 of a text file as it would be with ``lf`` or ``crlf`` line ends."""
    if newline not in ("lf", "crlf"):
        raise ValueError("newline must be lf or crlf")
    data = Path(path).read_bytes().replace(b"\r\n", b"\n")
    return hashlib.sha256(data if newline == "lf" else data.replace(b"\n", b"\r\n")).hexdigest()


def framed(value: str | bytes) -> bytes:
    """A value after its length as eight big-endian bytes, so that no two lists read alike."""
    raw = value.encode() if isinstance(value, str) else value
    return len(raw).to_bytes(8, "big") + raw


def framed_column(value: Column) -> Column:
    """:func:`framed` as a column expression (binary)."""
    raw = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw)


def ordered_id_sha256(ids: DataFrame | Iterable[Any], column: str = "id") -> str:
    """SHA-256 of length-framed ids; of a DataFrame in ascending order, streamed to the driver partition by partition."""
    h = hashlib.sha256()
    if isinstance(ids, DataFrame):
        ids = (r[0] for r in ids.select(F.col(column).cast("string").alias("v")).orderBy("v").toLocalIterator())
    for v in ids:
        h.update(framed(str(v)))
    return h.hexdigest()


def joined_id_sha256(ids: Iterable[Any]) -> str:
    """SHA-256 of ids joined by NUL."""
    return hashlib.sha256("\0".join(map(str, ids)).encode()).hexdigest()


def tree_manifest(folder: str | Path) -> dict[str, Any]:
    """Files of a folder with sizes and hashes, and one hash of the tree: framed relative paths and bytes, sorted by path."""
    base, h, files = Path(folder), hashlib.sha256(), []
    for p in sorted((p for p in base.rglob("*") if p.is_file()), key=lambda p: p.relative_to(base).as_posix()):
        name = p.relative_to(base).as_posix()
        h.update(framed(name))
        with open(p, "rb") as f:
            while block := f.read(_BLOCK):
                h.update(block)
        files.append({"path": name, "bytes": p.stat().st_size, "sha256": digest(p)})
    return {"files": files, "file_count": len(files), "bytes": sum(x["bytes"] for x in files), "tree_sha256": h.hexdigest()}


def tree_sha256(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of all files below a folder, hashed by the executors."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def check_tree(folder: str | Path, manifest: dict[str, Any]) -> None:
    found = tree_manifest(folder)
    if found["tree_sha256"] != manifest["tree_sha256"]:
        old = {f["path"]: f["sha256"] for f in manifest["files"]}
        new = {f["path"]: f["sha256"] for f in found["files"]}
        raise ValueError(f"folder differs from its manifest: {sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))}")


def pack_stage(folder: str | Path, archive: str | Path) -> dict[str, Any]:
    """An archive of a folder, and its manifest beside it."""
    made = shutil.make_archive(str(archive).removesuffix(".tar.gz"), "gztar", folder)
    manifest = tree_manifest(folder) | {"archive_sha256": digest(made)}
    write_json(made + ".json", manifest)
    return manifest


def unpack_stage(archive: str | Path, folder: str | Path) -> None:
    """Unpack after the archive's hash, and check the files after that."""
    manifest = json.loads(Path(f"{archive}.json").read_text())
    if digest(archive) != manifest["archive_sha256"]:
        raise ValueError("the archive's hash differs")
    shutil.unpack_archive(archive, folder, "gztar", filter="data")
    check_tree(folder, manifest)


def fetch(url: str, path: str | Path, *, timeout: float = 60.0) -> dict[str, Any]:
    """Download to a file that appears whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    with urllib.request.urlopen(url, timeout=timeout) as answer, open(part, "wb") as out:
        shutil.copyfileobj(answer, out, _BLOCK)
    part.replace(target)
    return {"source_url": url, "downloaded_at_unix": time.time(), "bytes": target.stat().st_size, "sha256": digest(target)}


def check_archive(path: str | Path, md5: str) -> None:
    if (found := digest(path, "md5")) != md5:
        raise ValueError(f"archive has MD5 {found}, not {md5}")


# -- JSON and configurations ------------------------------------------------------------------


def write_json(path: str | Path, value: Any) -> None:
    """Sorted keys, two spaces, UTF-8; the file is replaced whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f".{target.name}.{os.getpid()}.part")
    part.write_text(json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n", encoding="utf-8")
    os.replace(part, target)


def read_json(path: str | Path) -> Any:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def load_config(path: str | Path | None, command: str) -> dict[str, Any]:
    """A JSON (or, with PyYAML, YAML) mapping: the command's own section, else the whole; names with underscores."""
    if path is None:
        return {}
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("PyYAML is needed for YAML configurations") from e
        found = yaml.safe_load(text) or {}
    else:
        found = json.loads(text)
    if not isinstance(found, dict):
        raise TypeError("a configuration must be a mapping")
    section = found.get(command, found)
    if not isinstance(section, dict):
        raise TypeError(f"section {command} must be a mapping")
    return {k.replace("-", "_"): v for k, v in section.items()}


def with_flags(config: dict[str, Any], given: dict[str, Any], argv: list[str]) -> dict[str, Any]:
    """Options of a command: the configuration over the defaults, flags named in ``argv`` over both."""
    named = {a[2:].split("=")[0].replace("-", "_") for a in argv if a.startswith("--")}
    return given | {k: v for k, v in config.items() if k in given and k not in named}


def expanded(options: dict[str, Any], names: Iterable[str]) -> dict[str, Any]:
    """Environment variables in the named paths are filled in."""
    return options | {n: os.path.expandvars(options[n]) for n in names if isinstance(options.get(n), str)}


def required(options: dict[str, Any], *names: str) -> None:
    """An error names the options that are missing or empty (0 and "" count as missing)."""
    if missing := [n for n in names if not options.get(n)]:
        raise ValueError(f"missing: {', '.join(missing)}")


def named_paths(values: Iterable[str], what: str) -> dict[str, str]:
    """``name=path`` items with unique, non-empty names and paths."""
    out: dict[str, str] = {}
    for v in values:
        name, sep, path = v.partition("=")
        if not (sep and name and path) or name in out:
            raise ValueError(f"{what} needs unique name=path items, not {v!r}")
        out[name] = path
    return out


def member(value: Any, *keys: str) -> Any:
    """A nested member of a mapping; what lacks or isn't a mapping is an error."""
    for k in keys:
        if not isinstance(value, dict) or k not in value:
            raise TypeError(f"no {k} in the mapping")
        value = value[k]
    return value


# -- runs ---------------------------------------------------------------------------------------


def run_manifest(command: str, arguments: dict[str, Any], started_at: str, inputs: dict[str, str], *, repository: str | Path = ".") -> dict[str, Any]:
    """What a run was: arguments, times (the end after the start), commit, inputs' sizes and hashes, environment."""
    begin, end = datetime.fromisoformat(started_at), datetime.now(timezone.utc)
    end = max(end, begin + timedelta(microseconds=1))
    git = subprocess.run(["git", "-C", str(repository), "rev-parse", "HEAD"], capture_output=True, text=True)
    return {
        "command": command,
        "arguments": {k: v for k, v in sorted(arguments.items()) if not callable(v)},
        "started_at": begin.isoformat(), "finished_at": end.isoformat(), "seconds": (end - begin).total_seconds(),
        "commit": git.stdout.strip() or None,
        "inputs": {n: {"path": str(p), "bytes": Path(p).stat().st_size, "sha256": digest(p)} for n, p in sorted(inputs.items())},
        "environment": {"python": platform.python_version(), "platform": platform.platform(), "job_id": os.environ.get("SLURM_JOB_ID"), "devices": os.environ.get("CUDA_VISIBLE_DEVICES")},
    }


def write_run(
    folder: str | Path, *, command: str, arguments: dict[str, Any], metrics: dict[str, Any], started_at: str, inputs: dict[str, str],
    predictions: Iterable[dict] = (), errors: Iterable[dict] = (), notes: str = "", repository: str | Path = ".",
) -> dict[str, Any]:
    """run_manifest.json, metrics.json, predictions.jsonl, error_cases.jsonl and report.md. Rows may come from ``toLocalIterator``."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    manifest = run_manifest(command, arguments, started_at, inputs, repository=repository)
    write_json(base / "run_manifest.json", manifest)
    write_json(base / "metrics.json", metrics)
    for name, rows in (("predictions", predictions), ("error_cases", errors)):
        with open(base / f"{name}.jsonl", "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r, sort_keys=True, ensure_ascii=False) + "\n" for r in rows)
    lines = [f"# {command}", "", *(f"- {k}: {v}" for k, v in sorted(metrics.items()) if isinstance(v, int | float | str)), "", notes]
    (base / "report.md").write_text("\n".join(lines).rstrip() + "\n", encoding="utf-8")
    return manifest


def publication(parts: dict[str, Any], *, patterns: dict[str, str], fields: Iterable[str]) -> dict[str, Any]:
    """Compact JSON of a run: exactly the fields asked for, and no string that a pattern of secrets or local paths finds."""
    if missing := sorted(set(fields) - parts.keys()):
        raise ValueError(f"missing fields: {missing}")
    out = {k: parts[k] for k in fields}
    for place, name in secrets(out, patterns):
        raise ValueError(f"{place} holds a {name}")
    return out


def secrets(value: Any, patterns: dict[str, str], place: str = "$") -> Iterable[tuple[str, str]]:
    """(place, pattern) of every string of a nested value, keys included, that a pattern finds."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from secrets(str(k), patterns, f"{place}.{k}#key")
            yield from secrets(v, patterns, f"{place}.{k}")
    elif isinstance(value, list | tuple):
        for i, v in enumerate(value):
            yield from secrets(v, patterns, f"{place}[{i}]")
    elif isinstance(value, str):
        yield from ((place, n) for n, p in patterns.items() if re.search(p, value))


def load_metrics_files(paths: Iterable[str | Path]) -> dict[str, dict[str, Any]]:
    """Metrics by ``adapter_config_id``, each with its file's hash; a missing or repeated id is an error."""
    out: dict[str, dict[str, Any]] = {}
    for p in paths:
        row = read_json(p)
        if not isinstance(row, dict):
            raise TypeError(f"{p} is no object")
        name = str(row.get("adapter_config_id") or "")
        if not name or name in out:
            raise ValueError(f"missing or repeated adapter_config_id in {p}")
        out[name] = row | {"metrics_sha256": digest(p)}
    return out


def job_accounting(spark: SparkSession, path: str) -> DataFrame:
    """One row a job of a pipe-separated accounting file; the memory of its batch step counts, other steps are dropped."""
    n = len(ACCOUNTING_FIELDS)
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.rtrim(F.col("value"), F.lit("|")), r"\|", -1).alias("v"), "value")
    checked = F.when(F.size("v") == n, F.col("v")).otherwise(F.raise_error(F.concat(F.lit("odd accounting row: "), "value")).cast("array<string>"))
    raw = rows.select(checked.alias("v")).select(*[F.get("v", F.lit(i)).alias(f) for i, f in enumerate(ACCOUNTING_FIELDS)])
    step = F.regexp_extract("job_id", r"\.(.*)$", 1)
    job = raw.withColumn("step", step).withColumn("job", F.regexp_replace("job_id", r"\.(batch|extern)$", ""))
    main = lambda c: F.coalesce(F.max(F.when(F.col("step") == "", F.col(c))), F.lit(""))
    batch = F.max(F.when((F.col("step") == "batch") & (F.col("max_rss") != ""), F.col("max_rss")))
    own = [main(f).alias(f) for f in ACCOUNTING_FIELDS if f not in ("job_id", "max_rss")]
    out = job.groupBy("job").agg(*own, F.coalesce(batch, main("max_rss")).alias("max_rss"))
    return out.withColumnRenamed("job", "job_id").select(*ACCOUNTING_FIELDS)


# -- the transfer ledger -------------------------------------------------------------------------


def reserve_transfer(path: str | Path, *, config_sha256: str, attempt: str, retries: int = 2) -> dict[str, Any]:
    """Take the one external evaluation. The same configuration may try again ``retries`` times; another, or a completed one, may not."""
    if not re.fullmatch("[0-9a-f]{64}", config_sha256):
        raise ValueError("the configuration's SHA-256 is needed")
    fresh = {"status": "running", "frozen_config_sha256": config_sha256, "maximum_completed_evaluations": 1, "maximum_infrastructure_retries": retries}
    fresh["attempts"] = [{"attempt_id": attempt, "status": "running"}]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    try:
        with open(path, "x", encoding="utf-8") as f:  # whoever creates the file holds the reservation
            f.write(json.dumps(fresh, indent=2, sort_keys=True) + "\n")
        return fresh
    except FileExistsError:
        held = read_json(path)
    if held["frozen_config_sha256"] != config_sha256:
        raise ValueError("reserved for another configuration")
    if held["status"] == "completed":
        raise ValueError("the one evaluation is completed")
    if len(held["attempts"]) > retries:
        raise ValueError("no attempt is left")
    held["attempts"].append({"attempt_id": attempt, "status": "running"})
    write_json(path, held)
    return held


def complete_transfer(path: str | Path, *, attempt: str, metrics_sha256: str) -> dict[str, Any]:
    held = read_json(path)
    if held.get("status") != "running" or held["attempts"][-1]["attempt_id"] != attempt:
        raise ValueError("this attempt does not hold the reservation")
    held["attempts"][-1] |= {"status": "completed", "metrics_sha256": metrics_sha256}
    held |= {"status": "completed", "completed_evaluations": 1, "metrics_sha256": metrics_sha256}
    write_json(path, held)
    return held
