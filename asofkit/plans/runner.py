"""A staged run with a manifest: a stage runs on completed stages whose artefacts still have their hashes."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from asofkit.sources.sinks import files_hash, save_json, write_verified


class Run:
    """A folder of stages; settings are fixed at its start, and a stage that runs again invalidates those after it."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict, stages: list[tuple[str, list[str], Callable[..., DataFrame]]]):
        self.spark, self.folder, self.stages = spark, Path(folder), stages
        self.path = self.folder / "manifest.json"
        self.manifest = json.loads(self.path.read_text()) if self.path.exists() else {"settings": settings, "stages": {}}
        if self.manifest["settings"] != settings:
            raise ValueError("settings of a begun run don't change")

    def _checked(self, name: str, partial: bool) -> DataFrame:
        held = self.manifest["stages"].get(name, {})
        if held.get("status") not in ("completed", *(("completed_with_errors",) if partial else ())):
            raise ValueError(f"stage {name} isn't completed")
        if files_hash(self.spark, held["path"]) != held["hash"]:
            raise ValueError(f"stage {name}: its files have changed")
        return self.spark.read.parquet(held["path"])

    def run(self, only: str | None = None, partial: bool = False, errors: Callable[[DataFrame], int] | None = None) -> dict:
        """All stages, or one; each gets its inputs as tables."""
        for name, needs, make in self.stages:
            if only and name != only:
                continue
            self._forget(name)
            inputs = [self._checked(n, partial) for n in needs]
            try:
                path = str(self.folder / name)
                out = write_verified(make(self.spark, *inputs), path)
                bad = errors(out) if errors else 0
                self.manifest["stages"][name] = {"status": "completed_with_errors" if bad else "completed", "path": path, "hash": files_hash(self.spark, path), "rows": out.count(), "errors": bad}
            except Exception as e:
                self.manifest["stages"][name] = {"status": "failed", "error": f"{type(e).__name__}: {str(e)[:300]}"}
                save_json(self.path, self.manifest)
                raise
            save_json(self.path, self.manifest)
        return self.manifest

    def _forget(self, name: str) -> None:
        """Drops a stage and all that build on it from the manifest."""
        gone = {name}
        for other, needs, _ in self.stages:
            if gone & set(needs):
                gone.add(other)
        for g in gone:
            self.manifest["stages"].pop(g, None)
