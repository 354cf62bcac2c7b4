"""Front matter and inventories: YAML through its library where installed, else the plain subset they use."""

from __future__ import annotations

import re
from typing import Any

try:
    import yaml
except ImportError:
    yaml = None


class Unreadable(ValueError):
    pass


def load(text: str) -> Any:
    if yaml is not None:
        try:
            return yaml.safe_load(text)
        except Exception as error:  # any text at all may be given
            raise Unreadable(str(error)) from error
    return _mapping(text)


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        inner = text[1:-1].strip()
        return [_scalar(x) for x in inner.split(",")] if inner else []
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return {"": None, "~": None, "null": None, "true": True, "false": False}.get(text, text)


def _mapping(text: str) -> dict | None:
    """`key: value`, lists in brackets or with hyphens, one level deep."""
    found: dict[str, Any] = {}
    key = None
    for line in text.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.fullmatch(r"\s+-\s+(.*)|-\s+(.*)", line):
            if key is None or not isinstance(found[key], list | None):
                raise Unreadable(f"a list item without a key: {line!r}")
            found[key] = [*(found[key] or []), _scalar(m[1] or m[2])]
        elif m := re.fullmatch(r"([^\s:][^:]*):(?:\s+(.*))?", line):
            key = m[1].strip()
            found[key] = _scalar(m[2] or "")
        else:
            raise Unreadable(f"not a line of the form `key: value`: {line!r}")
    return found or None
