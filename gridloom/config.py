"""Run settings: dataclasses filled from a YAML file and `--name=value` arguments."""

from __future__ import annotations

import dataclasses
import sys
from typing import Any, get_type_hints


def cast(kind: Any, text: str) -> Any:
    """An argument's text as the field's type: numbers, `true` or `True` as true and all else as false, lists of text at commas."""
    if kind is bool:
        return text in ("true", "True")
    if kind in (int, float):
        return kind(text)
    return text.split(",") if kind == list[str] else text


def arguments(args: list[str]) -> dict[str, str]:
    out = {}
    for a in args:
        name, sign, value = a.lstrip("-").partition("=")
        if not sign:
            raise ValueError(f"not of the form --name=value: {a}")
        if name in out:
            raise ValueError(f"duplicate argument: {name}")
        out[name] = value
    return out


def load(path: str | None, args: list[str], *kinds: type) -> list[Any]:
    """One object of each dataclass: defaults, then the file's values, then the arguments'. An argument that two classes have, that none has or that comes twice is an error, and so is a name in the file that none has."""
    values: dict[str, Any] = {}
    if path is not None:
        try:
            import yaml
        except ImportError:  # JSON is YAML too
            import json as yaml
        with open(path) as f:
            values = (yaml.safe_load(f) if hasattr(yaml, "safe_load") else yaml.load(f)) or {}
    given = arguments(args)
    owners = {n: [k for k in kinds if n in {f.name for f in dataclasses.fields(k) if f.init}] for n in {*values, *given}}
    for n, k in owners.items():
        if not k:
            raise ValueError(f"unknown argument: {n}")
        if len(k) > 1 and n in given:
            raise ValueError(f"argument of several classes: {n}")
    out = []
    for k in kinds:
        hints = get_type_hints(k)
        own = {n: v for n, v in values.items() if k in owners[n]}
        own |= {n: cast(hints[n], v) for n, v in given.items() if k in owners[n]}
        out.append(k(**own))
    return out


def from_command_line(*kinds: type) -> list[Any]:
    """As load(), the file being the first argument where that ends in .yaml."""
    args = sys.argv[1:]
    path = args.pop(0) if args and args[0].endswith(".yaml") else None
    return load(path, args, *kinds)
