"""Settings of the engine, read from a mapping such as os.environ."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, fields

_SECONDS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> float:
    """Seconds of a duration such as 30s, 1m30s or 250ms."""
    if not re.fullmatch(r"(\d+(\.\d+)?(ms|s|m|h))+", text):
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(n) * _SECONDS[u] for n, _, u in re.findall(r"(\d+(\.\d+)?)(ms|s|m|h)", text))


@dataclass(frozen=True)
class Config:
    """Defaults are the storage format's: 64 MiB chunks, 4 KiB blocks, 1 TiB capacity."""

    location: str = "/tmp/packlake"
    prefix: str = ""
    endpoint: str = ""
    region: str = ""
    path_style: bool = False
    max_chunk_bytes: int = 64 << 20
    block_bytes: int = 4096
    max_fs_bytes: int = 1 << 40
    compaction_threshold: float = 0.3
    persist_interval: str = "30s"

    def __post_init__(self):
        for name in ("max_chunk_bytes", "block_bytes", "max_fs_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.compaction_threshold <= 1:
            raise ValueError("compaction_threshold must lie between 0 and 1")
        parse_duration(self.persist_interval)

    @property
    def root(self) -> str:
        """Folder or prefix that holds this tenant's objects."""
        return "/".join(x.strip("/") if k else x.rstrip("/") for k, x in enumerate((self.location, self.prefix)) if x)

    @property
    def trigger(self) -> str:
        return f"{round(parse_duration(self.persist_interval) * 1000)} milliseconds"

    def hadoop_options(self) -> dict[str, str]:
        """Spark settings of an S3-compatible store; credentials come from the environment."""
        out = {}
        if self.endpoint:
            out["spark.hadoop.fs.s3a.endpoint"] = self.endpoint
        if self.region:
            out["spark.hadoop.fs.s3a.endpoint.region"] = self.region
        if self.path_style:
            out["spark.hadoop.fs.s3a.path.style.access"] = "true"
        return out


def load(env: Mapping[str, str], prefix: str = "PACKLAKE_") -> Config:
    """Settings from PACKLAKE_<NAME>; a value that can't be parsed is an error that names it."""
    given = {}
    for f in fields(Config):
        if (text := env.get(prefix + f.name.upper())) in (None, ""):
            continue
        kind = type(f.default)
        try:
            if kind is bool:
                given[f.name] = {"true": True, "1": True, "false": False, "0": False}[text.lower()]
            else:
                given[f.name] = kind(text)
        except (ValueError, KeyError) as e:
            raise ValueError(f"{prefix}{f.name.upper()}: bad value {text!r}") from e
    return Config(**given)
