"""Settings from a TOML file: typed, with defaults, and errors that name the key and what it should be."""

from __future__ import annotations

import difflib
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Input:
    path: str = ""
    files_per_batch: int = 100


@dataclass(frozen=True)
class Storage:
    path: str = ""
    checkpoint: str = ""
    correction: str = "arrival"


@dataclass(frozen=True)
class Retention:
    policy: str = "drop_oldest"
    max_rows: int = 1_000_000
    quarantine_rows: int = 10_000


@dataclass(frozen=True)
class Shipping:
    sink: str = "jsonl"
    path: str = ""
    url: str = ""
    token_file: str = ""
    device_id: str = ""
    host: str = ""
    port: int = 1883
    client_id: str = ""
    username: str = ""
    password_file: str = ""
    tls: str = "off"
    ca_file: str = ""
    ack_timeout_s: float = 10.0
    send_timeout_s: float = 300.0
    batch_rows: int = 1_000_000
    hold_s: float = 120.0
    purge_every: int = 10
    most_failures: int = 10
    initial_backoff_s: float = 0.5
    max_backoff_s: float = 60.0
    immediate_retries: int = 2


@dataclass(frozen=True)
class Config:
    input: Input = field(default_factory=Input)
    storage: Storage = field(default_factory=Storage)
    retention: Retention = field(default_factory=Retention)
    shipping: Shipping = field(default_factory=Shipping)


#: What a setting may be.
CHOICES = {"policy": ("drop_oldest", "halt_and_alarm"), "sink": ("jsonl", "http", "mqtt"), "correction": ("arrival", "converged"), "tls": ("off", "on")}
#: What a sink can't do without.
NEEDED = {"jsonl": "path", "http": "url", "mqtt": "host"}


def _unknown(name: str, known: list[str], where: str) -> ConfigError:
    near = difflib.get_close_matches(name, known, 1)
    return ConfigError(f"{where}: unknown {name!r}" + (f", did you mean {near[0]!r}?" if near else f"; known: {', '.join(known)}"))


def parse(text: str, source: str = "config") -> Config:
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"{source}: {e}") from e
    sections, out = {f.name: f.default_factory for f in fields(Config)}, {}
    for name, values in data.items():
        if name not in sections:
            raise _unknown(name, list(sections), source)
        if not isinstance(values, dict):
            raise ConfigError(f"{source}: {name} must be a section")
        known = {f.name: type(f.default) for f in fields(sections[name])}
        for key, value in values.items():
            where = f"{source}: {name}.{key}"
            if key not in known:
                raise _unknown(key, list(known), f"{source}: [{name}]")
            if isinstance(value, bool) or not isinstance(value, (int, float) if known[key] is float else known[key]):
                raise ConfigError(f"{where} must be of type {known[key].__name__}")
            if key in CHOICES and value not in CHOICES[key]:
                raise ConfigError(f"{where} must be one of {', '.join(CHOICES[key])}")
            if known[key] in (int, float) and value < (0 if key in ("immediate_retries", "initial_backoff_s", "hold_s", "most_failures") else 1):
                raise ConfigError(f"{where} is too small")
        out[name] = sections[name](**values)
    config = Config(**out)
    if config.shipping.max_backoff_s < config.shipping.initial_backoff_s:
        raise ConfigError(f"{source}: shipping.max_backoff_s must not be under initial_backoff_s")
    if "shipping" in out and not getattr(config.shipping, NEEDED[config.shipping.sink]):
        raise ConfigError(f"{source}: shipping.{NEEDED[config.shipping.sink]} must be set for sink {config.shipping.sink!r}")
    return config


def load(path: str) -> Config:
    return parse(Path(path).read_text(), path)
