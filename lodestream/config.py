"""Settings with where each came from: a flag goes before the environment, that before a file, and that before the default."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping
from dataclasses import dataclass

#: The engine's settings and their defaults.
DEFAULTS: dict[str, object] = {"step_s": 1.0, "stream_lateness_s": 2.0, "idle_s": 30.0, "snapshot_s": 30.0, "fix_ttl_s": 30.0, "summary_s": 60.0, "notices": 10, "heartbeat_s": 1.0, "run_id": "run"}
PREFIX = "LODESTREAM_"


@dataclass(frozen=True)
class Setting:
    value: object
    source: str


def parse_env(text: str) -> dict[str, str]:
    """Lines NAME=value; blank ones and those that begin with # say nothing, quotes around a value are dropped, ``export`` before a name too."""
    found = {}
    for number, line in enumerate(text.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        name, equals, value = line.removeprefix("export ").partition("=")
        if not equals or not name.strip().isidentifier():
            raise ValueError(f"line {number} is not NAME=value")
        value = value.strip()
        found[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return found


def _as(default: object, value: object, name: str) -> object:
    try:
        return type(default)(value)
    except (TypeError, ValueError) as wrong:
        raise ValueError(f"{name} is no {type(default).__name__}: {value!r}") from wrong


def settings(flags: Mapping[str, object] = {}, env: Mapping[str, str] = {}, file_text: str = "", file_name: str = "file") -> dict[str, Setting]:  # noqa: B006
    """Every setting with its source; unknown names are refused."""
    held = tomllib.loads(file_text)
    if unknown := sorted((set(held) | set(flags)) - set(DEFAULTS)):
        raise ValueError(f"unknown settings {unknown}")
    found = {}
    for name, default in DEFAULTS.items():
        variable = PREFIX + name.upper()
        if flags.get(name) is not None:
            found[name] = Setting(_as(default, flags[name], name), "flag")
        elif variable in env:
            found[name] = Setting(_as(default, env[variable], name), f"environment {variable}")
        elif name in held:
            found[name] = Setting(_as(default, held[name], name), file_name)
        else:
            found[name] = Setting(default, "default")
    return found
