"""Writing a result package: staged, complete, and renamed into place."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile

from pyspark.sql import DataFrame


def fingerprint(value) -> str:
    """sha256 of canonical JSON without volatile keys."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items() if k not in ("created_at", "generated_at", "output_dir")}
        return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

    return "sha256:" + hashlib.sha256(json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def write_package(folder: str, documents: dict[str, object], overwrite: bool = False) -> str:
    """Small JSON documents (collected summaries) and their manifest, all or none; foreign files in the folder are an error."""
    names = {f"{k}.json" for k in documents} | {"manifest.json"}
    if os.path.isdir(folder):
        if foreign := set(os.listdir(folder)) - names:
            raise FileExistsError(f"foreign files: {sorted(foreign)}")
        if os.listdir(folder) and not overwrite:
            raise FileExistsError(folder)
    os.makedirs(os.path.dirname(os.path.abspath(folder)), exist_ok=True)
    stage = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(folder)))
    try:
        for k, v in documents.items():
            with open(f"{stage}/{k}.json", "w") as f:
                json.dump(v, f, sort_keys=True, indent=1, ensure_ascii=False, default=str)
        with open(f"{stage}/manifest.json", "w") as f:
            json.dump({k: fingerprint(json.loads(json.dumps(v, default=str))) for k, v in sorted(documents.items())}, f, sort_keys=True, indent=1)
        if os.path.isdir(folder):
            shutil.rmtree(folder)
        os.rename(stage, folder)
    finally:
        shutil.rmtree(stage, ignore_errors=True)
    return folder


def verify_package(folder: str) -> list[str]:
    """Names that are missing, foreign or changed; empty if the package holds."""
    with open(f"{folder}/manifest.json") as f:
        manifest = json.load(f)
    there = {x[:-5] for x in os.listdir(folder) if x != "manifest.json"}
    bad = sorted(there ^ manifest.keys())
    for k in sorted(there & manifest.keys()):
        with open(f"{folder}/{k}.json") as f:
            if fingerprint(json.load(f)) != manifest[k]:
                bad.append(k)
    return bad


def write_registries(folder: str, registries: dict[str, DataFrame]) -> None:
    """Large registries as Parquet, one folder each."""
    for name, df in registries.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
