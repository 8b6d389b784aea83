"""Configuration of sources and networks from YAML, with defaults and validation."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml

from geoloom.operators.features import UserError

NAME = re.compile(r"^[A-Za-z0-9_.-]+$")
TYPES = ("geojson", "geopackage", "mbtiles", "postgis", "parquet")


@dataclass
class SourceConfig:
    name: str
    type: str
    path: str = ""
    dsn: str = ""
    table: str = ""
    layer: str = ""
    title: str = ""
    geometry_column: str = "geom"
    id_column: str = ""
    fields: list[str] = field(default_factory=list)
    min_zoom: int = 0
    max_zoom: int | None = None
    simplify: bool = True


@dataclass
class NetworkConfig:
    name: str
    source: str
    speed_kmh: float = 5.0
    speed_field: str = ""
    oneway_field: str = ""


@dataclass
class Config:
    host: str = "0.0.0.0"
    port: int = 8080
    base_url: str = ""
    api_keys: list[str] = field(default_factory=list)
    cache_ttl_s: float = 300.0
    cache_entries: int = 10_000
    disk_dir: str = ""
    disk_ttl_s: float = 86_400.0
    disk_mb: int = 512
    timeout_s: float = 30.0
    cors: bool = True
    sources: list[SourceConfig] = field(default_factory=list)
    networks: list[NetworkConfig] = field(default_factory=list)


_UNITS = {"ms": 0.001, "s": 1.0, "m": 60.0, "h": 3600.0}


def seconds(text: str | int | float) -> float:
    """Seconds of a duration like 1h30m, 2m or 300ms; plain numbers are seconds."""
    if isinstance(text, (int, float)):
        return float(text)
    parts = re.findall(r"([0-9.]+)(ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise UserError(f"bad duration {text!r}")
    return sum(float(a) * _UNITS[b] for a, b in parts)


def load(text: str, env_key: str = "API_KEY") -> Config:
    raw = yaml.safe_load(text) or {}
    server, cache = raw.get("server") or {}, raw.get("cache") or {}
    own = lambda kind, row: kind(**{k: v for k, v in row.items() if k in kind.__dataclass_fields__})
    default = Config()
    out = Config(
        host=server.get("host", default.host), port=int(server.get("port", default.port)), base_url=server.get("base_url", ""), api_keys=list(server.get("api_keys") or []),
        cache_ttl_s=seconds(cache.get("ttl", default.cache_ttl_s)), cache_entries=int(cache.get("max_entries", default.cache_entries)),
        disk_dir=str((cache.get("disk") or {}).get("dir") or ""), disk_ttl_s=seconds((cache.get("disk") or {}).get("ttl", default.disk_ttl_s)), disk_mb=int((cache.get("disk") or {}).get("max_size_mb", default.disk_mb)),
        timeout_s=seconds(server.get("request_timeout", default.timeout_s)), cors=bool(server.get("cors", default.cors)),
        sources=[own(SourceConfig, s) for s in raw.get("sources") or []], networks=[own(NetworkConfig, n) for n in raw.get("networks") or []],
    )
    if os.environ.get(env_key):
        out.api_keys.append(os.environ[env_key])
    validate(out)
    return out


def validate(config: Config) -> None:
    if not config.sources:
        raise UserError("no sources are configured")
    seen: set[str] = set()
    for s in config.sources:
        if not NAME.match(s.name or ""):
            raise UserError(f"bad source name {s.name!r}")
        if s.name in seen:
            raise UserError(f"source {s.name} is configured twice")
        seen.add(s.name)
        if s.type not in TYPES:
            raise UserError(f"source {s.name}: unknown type {s.type!r}")
        if s.type == "postgis" and not (s.dsn and s.table):
            raise UserError(f"source {s.name}: dsn and table are needed")
        if s.type != "postgis" and not s.path:
            raise UserError(f"source {s.name}: a path is needed")
        if s.max_zoom is not None and s.min_zoom > s.max_zoom:
            raise UserError(f"source {s.name}: min_zoom is above max_zoom")
    for n in config.networks:
        if n.source not in seen:
            raise UserError(f"network {n.name}: unknown source {n.source!r}")
