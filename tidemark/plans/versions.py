"""Stamps of prompts and prose, schema versions, and the checks of configuration files."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

from .. import config as C

#: Names that the schema's own keywords give to fields: below these, keys are names.
_NAMED = ("properties", "$defs", "definitions", "patternProperties")
_MIGRATION = re.compile(r"\d{4}_[a-z0-9_]+\.sql")


def prompt_version(prompts: dict[str, bytes]) -> str:
    """Identity of the prompts, by name and content: 16 hex digits."""
    whole = hashlib.sha256()
    for name, body in sorted(prompts.items()):
        whole.update(name.encode() + b"\0" + body + b"\0")
    return whole.hexdigest()[:16]


def read_prompts(folder: str) -> dict[str, bytes]:
    return {p.name: p.read_bytes() for p in Path(folder).glob("*.md")}


def prose_version(prompts: dict[str, bytes], budgets: dict[str, int], bounds: dict[str, int]) -> str:
    """Identity of what writes an angle: the prompts, the budgets of tokens, the bounds of the fields and what counts as a leak."""
    parts = [prompt_version(prompts), *(f"{k}={v}" for d in (budgets, bounds) for k, v in sorted(d.items())), C.CODE_PATTERN, C.SLUG_PATTERN]
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def without_annotations(schema):
    """A JSON schema without descriptions and titles; fields of these names stay."""
    if isinstance(schema, list):
        return [without_annotations(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    named = lambda v: {name: without_annotations(x) for name, x in v.items()} if isinstance(v, dict) else v
    return {k: named(v) if k in _NAMED else without_annotations(v) for k, v in schema.items() if k not in ("description", "title")}


def schema_versions(files: list[str], applied: list[str]) -> list[tuple[str, bool]]:
    """(version, is it applied) of the migration files in their order; a wrong name, or one applied that isn't there, is an error."""
    for f in files:
        if not _MIGRATION.fullmatch(f):
            raise ValueError(f"{f!r} should be called NNNN_lower_snake.sql")
    known = sorted(f.removesuffix(".sql") for f in files)
    if gone := set(applied) - set(known):
        raise ValueError(f"applied, but not there: {sorted(gone)}")
    return [(v, v in applied) for v in known]


def checked_config(name: str, found, required: tuple[str, ...]) -> dict:
    """A loaded configuration, or an error that says what is wrong with it."""
    if not isinstance(found, dict):
        raise ValueError(f"{name}: expected a mapping, found {type(found).__name__}")
    if missing := [k for k in required if not found.get(k)]:
        raise ValueError(f"{name}: {missing} missing or empty")
    return found
