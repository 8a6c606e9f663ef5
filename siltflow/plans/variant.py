"""Variants: stage graphs from YAML or JSON files, with inheritance, interpolation and validation."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from siltflow.functions.expression import ExpressionError, parse
from siltflow.sources.texts import yaml

BUILTINS = ("route", "filter", "dedup", "group-by", "spread", "toggle")
STANDARD_TOOLS = ("scan-fs", "read-file-stream", "write-file-stream", "write-file-stream-hashed", "normalize", "gate", "checkpoint")
# The fields of a stage.
STAGE_FIELDS = ("tool", "settings", "settings_file", "input", "replicas", "replicas_routing", "trace", "cache", "on_error", "routes", "expression", "on_false", "dedup", "group_by", "env")
#: Where ${VAR} is filled in.
INTERPOLATED = ("settings", "expression", "routes", "dedup", "group_by", "env")


class VariantError(ValueError):
    """A variant that cannot be loaded; `errors` lists all that is wrong."""

    def __init__(self, *errors: str):
        super().__init__("; ".join(errors))
        self.errors = list(errors)


@dataclass
class Variant:
    name: str
    pipeline: str
    stages: dict[str, dict[str, Any]] = field(default_factory=dict)


def _load(folder: str, name: str) -> dict[str, Any]:
    for ext in ("yaml", "yml", "json"):
        path = os.path.join(folder, f"{name}.{ext}")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as file:
                found = json.load(file) if ext == "json" else yaml.safe_load(file)
            if not isinstance(found, dict):
                raise VariantError(f"{path}: not an object")
            return found
    raise VariantError(f"no variant {name!r} in {folder}")


def deep_merge(base: Any, over: Any) -> Any:
    """Objects merge by key; all else, arrays too, is replaced."""
    if isinstance(base, dict) and isinstance(over, dict):
        return base | {k: deep_merge(base[k], v) if k in base else v for k, v in over.items()}
    return over


def load_variant(folder: str, name: str, pipeline: str | None = None) -> Variant:
    """A variant with its parents: a child's stages replace, its overrides merge into stages that have to exist."""
    chain: list[dict[str, Any]] = []
    seen: list[str] = []
    now: str | None = name
    while now is not None:
        if now in seen:
            raise VariantError(f"extends goes in a circle: {' -> '.join([*seen, now])}")
        seen.append(now)
        spec = _load(folder, now)
        if unknown := set(spec) - {"pipeline", "variant", "extends", "stages", "overrides"}:
            raise VariantError(f"{now}: unknown fields {sorted(unknown)}")
        if spec.get("variant", now) != now or (pipeline and spec.get("pipeline", pipeline) != pipeline):
            raise VariantError(f"{now}: names don't match the file: {spec.get('pipeline')}:{spec.get('variant')}")
        chain.append(spec)
        now = spec.get("extends")
    stages: dict[str, dict[str, Any]] = {}
    for spec in reversed(chain):
        stages |= spec.get("stages") or {}
        for stage, over in (spec.get("overrides") or {}).items():
            if stage not in stages:
                raise VariantError(f"override of a missing stage {stage!r}")
            stages[stage] = deep_merge(stages[stage], over)
    return Variant(name, pipeline or chain[0].get("pipeline", ""), stages)


def interpolate(text: str, environ: Mapping[str, str]) -> str:
    """${VAR}, ${VAR:-default} (nested), and \\${ for a literal."""
    out, at = [], 0
    while at < len(text):
        if text.startswith("\\${", at):
            out.append("${")
            at += 3
        elif text.startswith("${", at):
            depth, end = 1, at + 2
            while end < len(text) and depth:
                if text.startswith("${", end):
                    depth, end = depth + 1, end + 2
                    continue
                depth -= text[end] == "}"
                end += 1
            if depth:
                raise VariantError(f"unclosed ${{ in {text!r}")
            name, sep, default = text[at + 2 : end - 1].partition(":-")
            if name in environ:  # empty too
                out.append(environ[name])
            elif sep:
                out.append(interpolate(default, environ))
            else:
                raise VariantError(f"environment variable {name} isn't set")
            at = end
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def filled(value: Any, environ: Mapping[str, str]) -> Any:
    if isinstance(value, str):
        return interpolate(value, environ)
    if isinstance(value, list):
        return [filled(x, environ) for x in value]
    if isinstance(value, dict):
        return {k: filled(v, environ) for k, v in value.items()}
    return value


def with_prefixes(value: Any, prefixes: Mapping[str, str]) -> Any:
    """$name at the beginning of a setting becomes its path; unknown names stay."""
    if isinstance(value, str):
        m = re.match(r"\$([A-Za-z_]\w*)(?=/|$)", value)
        return prefixes[m[1]].rstrip("/") + value[m.end() :] if m and m[1] in prefixes else value
    if isinstance(value, list):
        return [with_prefixes(x, prefixes) for x in value]
    if isinstance(value, dict):
        return {k: with_prefixes(v, prefixes) for k, v in value.items()}
    return value


def prefixes_in_text(text: str, prefixes: Mapping[str, str]) -> str:
    """$name anywhere in an expression becomes its path; unknown names stay."""
    return re.sub(r"\$([a-z0-9-]+)", lambda m: prefixes[m[1]].rstrip("/") if m[1] in prefixes else m[0], text)


def to_token(path: str, prefixes: Mapping[str, str]) -> str:
    """The token form of an absolute path, by the longest prefix."""
    for name, base in sorted(prefixes.items(), key=lambda x: -len(x[1])):
        base = base.rstrip("/")
        if path == base or path.startswith(base + "/"):
            return f"${name}{path[len(base) :]}"
    return path


def inputs_of(stage: Mapping[str, Any]) -> list[str]:
    found = stage.get("input", "$input")
    return list(found) if isinstance(found, list) else [found]


def order(stages: Mapping[str, Mapping[str, Any]]) -> list[str]:
    """Stages after their inputs, by name among those that are ready."""
    needs = {k: {x.split(".")[0] for x in inputs_of(s) if x != "$input" and x.split(".")[0] in stages} for k, s in stages.items()}
    out: list[str] = []
    while needs:
        ready = sorted(k for k, v in needs.items() if v <= set(out))
        if not ready:
            raise VariantError(f"stages in a circle: {sorted(needs)}")
        out.append(ready[0])
        del needs[ready[0]]
    return out


def validate(variant: Variant, tools: Mapping[str, Any] = (), environ: Mapping[str, str] | None = None, prefixes: Mapping[str, str] | None = None) -> list[str]:
    """All that is wrong with a variant; files that it names have to be there."""
    environ = os.environ if environ is None else environ
    errors: list[str] = []
    uses: dict[str, int] = {}
    for name, stage in variant.stages.items():
        say = lambda text, name=name: errors.append(f"{name}: {text}")
        for x in sorted(set(stage) - set(STAGE_FIELDS)):
            say(f"unknown field {x!r}")
        tool = stage.get("tool")
        if tool not in BUILTINS and tool not in STANDARD_TOOLS and tool not in tools:
            say(f"unknown tool {tool!r}")
        refs = inputs_of(stage)
        if len(refs) > 1 and "$input" in refs:
            say("$input cannot be merged with stages")
        for ref in refs:
            source, _, channel = ref.partition(".")
            if ref == "$input":
                continue
            if source not in variant.stages:
                say(f"input {ref!r} doesn't exist")
                continue
            is_route = variant.stages[source].get("tool") == "route"
            if channel and channel not in (variant.stages[source].get("routes") or {}):
                say(f"no channel {ref!r}")
            if is_route and not channel:
                say(f"{source!r} is a route: name a channel")
            if not channel:
                uses[source] = uses.get(source, 0) + 1
        for key in INTERPOLATED:
            try:
                filled(stage.get(key), environ)
            except VariantError as e:
                say(str(e))
        texts = [stage["expression"]] if tool == "filter" and stage.get("expression") else list((stage.get("routes") or {}).values()) if tool == "route" else []
        if tool == "filter" and not stage.get("expression"):
            say("filter has no expression")
        if tool == "route" and not stage.get("routes"):
            say("route has no routes")
        if tool == "group-by" and not stage.get("group_by"):
            say("group-by has no group_by")
        for text in texts:
            try:
                parse(filled(text, environ))
            except (ExpressionError, VariantError) as e:
                say(str(e))
        for x in stage.get("env") or []:
            if x not in environ:
                say(f"environment variable {x} isn't set")
        settings = stage.get("settings") or {}
        for what, path in (("settings_file", stage.get("settings_file")), ("rulebook", settings.get("rulebook") if tool == "normalize" else None)):
            if not path:
                continue
            try:
                with open(with_prefixes(filled(path, environ), prefixes or {}), encoding="utf-8") as file:
                    if what == "settings_file" and not isinstance(json.load(file), dict):
                        say(f"{what}: not an object")
            except (OSError, ValueError) as e:
                say(f"{what}: {e}")
    for source, n in uses.items():
        if n > 1 and variant.stages[source].get("tool") not in ("route", "spread"):
            errors.append(f"{source}: {n} consumers; put a spread between")
    for name, stage in variant.stages.items():
        if stage.get("tool") == "spread" and not uses.get(name):
            errors.append(f"{name}: spread has no consumer")
    try:
        order(variant.stages)
    except VariantError as e:
        errors += e.errors
    return errors
