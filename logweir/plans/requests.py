"""Parsing of query parameters."""

from __future__ import annotations

from ..functions import times
from ..model import LEVELS, BadRequest

ATTRIBUTE = "attr."


def single(params: dict, name: str) -> str | None:
    """A parameter given once; one given several times, as a list, counts as absent."""
    value = params.get(name)
    return value if isinstance(value, str) else None


def text(params: dict, name: str) -> str | None:
    value = single(params, name)
    if value == "":
        raise BadRequest(f"{name} must be a non-empty string")
    return value


def instant(params: dict, name: str, required: bool = False) -> int | None:
    raw = single(params, name)
    if raw is None:
        if required:
            raise BadRequest(f"{name} is required")
        return None
    us = times.parse_iso(raw)
    if us is None:
        raise BadRequest(f"{name} must be a valid ISO 8601 timestamp")
    return us


def one_of(params: dict, name: str, allowed, required: bool = False) -> str | None:
    value = single(params, name)
    if value is None and required:
        raise BadRequest(f"{name} is required")
    if value is not None and value not in allowed:
        raise BadRequest(f"{name} must be one of {', '.join(allowed)}")
    return value


def common_filters(params: dict) -> dict:
    """service, level, q and attributes."""
    found = {"service": text(params, "service"), "level": one_of(params, "level", LEVELS), "q": text(params, "q")}
    attributes = {}
    for name, value in params.items():
        if not name.startswith(ATTRIBUTE):
            continue
        if name == ATTRIBUTE:
            raise BadRequest("attribute filter key must not be empty")
        if not isinstance(value, str):
            raise BadRequest(f"attribute filter {name} must have a single value")
        attributes[name.removeprefix(ATTRIBUTE)] = value
    return found | {"attributes": attributes}
