"""Configuration files: TOML, strict about unknown fields and about what the values mean. Driver side, no Spark."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from .discovery import Rule


class ConfigError(ValueError):
    """What is wrong with a configuration."""


@dataclass(frozen=True)
class Settings:
    name: str
    languages: tuple[str, ...]
    rules: tuple[Rule, ...] = (Rule("default"),)
    max_tasks: int = 40
    repair_budget: int = 2
    routing: dict[str, str] = field(default_factory=dict)


def _only(where: str, got: dict, known: set[str]) -> None:
    if unknown := sorted(set(got) - known):
        raise ConfigError(f"{where}: unknown fields {', '.join(unknown)}")


def template_errors(template: str) -> list[str]:
    """Problems of a target template."""
    out = []
    if "{lang}" not in template:
        out.append("no {lang}")
    if set(re.findall(r"\{([^}]*)\}", template)) - {"lang", "relpath"}:
        out.append("unknown placeholder")
    if template.startswith("/") or any(p in ("", ".", "..") for p in template.split("/")):
        out.append("not a plain relative path")
    return out


def parse(text: str) -> Settings:
    try:
        raw = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    _only("top", raw, {f.name for f in fields(Settings)})
    if not raw.get("name") or not raw.get("languages"):
        raise ConfigError("name and languages are required")
    if len(set(raw["languages"])) != len(raw["languages"]):
        raise ConfigError("a language is listed twice")
    if any(not re.fullmatch(r"[A-Za-z]{2,3}(?:[-_][A-Za-z0-9]+)*", x) for x in raw["languages"]):
        raise ConfigError("not a language tag")
    rules = []
    for r in raw.pop("rules", []):
        _only("rules", r, {f.name for f in fields(Rule)} - {"meta"})
        rule = Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()})
        if problems := template_errors(rule.target):
            raise ConfigError(f"rule {rule.name}: {'; '.join(problems)}")
        if not rule.single and "{relpath}" not in rule.target:
            raise ConfigError(f"rule {rule.name}: a rule for several files needs {{relpath}}")
        rules.append(rule)
    if len({r.name for r in rules}) != len(rules):
        raise ConfigError("two rules have one name")
    for key in ("max_tasks", "repair_budget"):
        if raw.get(key, 0) < 0:
            raise ConfigError(f"{key} is negative")
    return Settings(**raw | {"languages": tuple(raw["languages"])} | ({"rules": tuple(rules)} if rules else {}))


def load(path: str | Path) -> Settings:
    return parse(Path(path).read_text(encoding="utf-8"))
