"""Configuration in layers: defaults, user file, nearest project file, environment; with the source of each value."""

from __future__ import annotations

import os
import re
import tomllib
import warnings
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS: dict[str, object] = {
    "store.path": "", "store.collection": "", "embedding.provider": "keywords", "embedding.max_chars": 8192, "index.max_kb": 0, "index.patterns": "",
    "search.top_k": 10, "daemon.idle_timeout": "10m",
}
DURATIONS = ("daemon.idle_timeout",)
#: Keys whose empty environment value counts as a value.
EMPTY_COUNTS = ("store.collection", "store.path")
FILE_NAME, ENV_PREFIX, MOST_PARENTS = "tallyglass.toml", "TALLYGLASS_", 12


@dataclass
class Config:
    values: dict[str, object]
    sources: dict[str, str]
    warnings: list[str] = field(default_factory=list)

    def rows(self, spark: SparkSession) -> DataFrame:
        """key, value, source in order of key."""
        return spark.createDataFrame([(k, str(self.values[k]), self.sources[k]) for k in sorted(self.values)], "key string, value string, source string")

    def lines(self) -> list[str]:
        return [f"{k} = {self.values[k]} ({self.sources[k]})" for k in sorted(self.values)]


def seconds(text: str) -> float:
    """A positive duration such as 90s, 10m, 1h30m."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text.strip())
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"{text!r} is no duration")
    total = sum(float(n) * {"ms": 0.001, "s": 1, "m": 60, "h": 3600}[u] for n, u in parts)
    if total <= 0:
        raise ValueError(f"{text!r} isn't positive")
    return total


def project_file(start: Path, home: Path) -> Path | None:
    """The nearest project file upwards; the search ends at a repository's root, at home, or after twelve parents outside home."""
    inside = start == home or home in start.parents
    for n, folder in enumerate([start, *start.parents]):
        if folder == home or (not inside and n > MOST_PARENTS):
            return None
        if (folder / FILE_NAME).is_file():
            return folder / FILE_NAME
        if (folder / ".git").exists():
            return None
    return None


def _flat(table: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in table.items():
        out |= _flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out


def load(project: str | Path = ".", user_file: Path | None = None, env: dict[str, str] | None = None, home: Path | None = None) -> Config:
    home = home or Path.home()
    env = dict(os.environ) if env is None else env
    config = Config(dict(DEFAULTS), dict.fromkeys(DEFAULTS, "default"))
    for path, source in ((user_file or home / ".config" / FILE_NAME, "user"), (project_file(Path(project).resolve(), home), "project")):
        if path is None or not path.is_file():
            continue
        for k, v in _flat(tomllib.loads(path.read_text())).items():
            if k not in DEFAULTS:
                config.warnings.append(f"unknown key {k} in {path}")
                continue
            config.values[k], config.sources[k] = v, source
    for k, default in DEFAULTS.items():
        raw = env.get(ENV_PREFIX + k.upper().replace(".", "_"))
        if raw is None or (raw == "" and k not in EMPTY_COUNTS):
            continue
        if isinstance(default, int):
            try:
                config.values[k] = int(raw)
            except ValueError:
                config.warnings.append(f"{raw!r} for {k} is no number")
                continue
        else:
            config.values[k] = raw
        config.sources[k] = "env"
    for k in DURATIONS:
        seconds(str(config.values[k]))
    for w in config.warnings:
        warnings.warn(w, stacklevel=2)
    return config
