"""Legacy function objects converted to expressions."""

from __future__ import annotations

import re
from typing import Any


def convert(f: dict, kind: str = "number", interpolated: bool = True) -> Any:
    """The expression of a legacy function: identity, exponential, interval or categorical over zoom, a property, or both."""
    prop, stops = f.get("property"), f.get("stops")
    how = f.get("type") or ("exponential" if interpolated and stops else "interval" if stops else "identity")
    if stops is None:
        value = ["get", prop]
        out = {"number": ["number", value], "string": ["string", value], "boolean": ["boolean", value], "color": ["to-color", value]}.get(kind, value)
        return ["case", ["==", ["typeof", value], kind if kind != "color" else "string"], out, f["default"]] if "default" in f else out
    if isinstance(stops[0][0], dict):
        by_zoom: dict[float, list] = {}
        for at, out in stops:
            by_zoom.setdefault(at["zoom"], []).append([at["value"], out])
        parts = [y for z, own in sorted(by_zoom.items()) for y in (z, convert({**f, "stops": own}, kind, interpolated))]
        if how == "exponential":
            return [_name(f), ["exponential", f.get("base", 1)], ["zoom"], *parts]
        return ["step", ["zoom"], parts[1], *parts[2:]]
    x = ["zoom"] if prop is None else ["get", prop]
    outs = [(a, _tokens(o) if prop is None and isinstance(o, str) and kind == "string" else o) for a, o in stops]
    if how == "categorical":
        if isinstance(stops[0][0], bool):
            table = dict(outs)
            return ["case", ["==", x, True], table.get(True, f.get("default")), ["==", x, False], table.get(False, f.get("default")), f.get("default")]
        return ["match", x, *(y for a, o in outs for y in (a, o)), f.get("default")]
    if how == "interval":
        body = ["step", x, outs[0][1], *(y for a, o in outs[1:] for y in (a, o))] if len(outs) > 1 else outs[0][1]
    elif how == "exponential":
        body = [_name(f), ["exponential", f.get("base", 1)], x, *(y for a, o in outs for y in (a, o))] if len(outs) > 1 else outs[0][1]
    else:
        raise ValueError(f"no legacy function type {how!r}")
    if prop is not None and "default" in f:
        return ["case", ["==", ["typeof", x], "number"], body, f["default"]]
    return body


def _name(f: dict) -> str:
    return {"lab": "interpolate-lab", "hcl": "interpolate-hcl"}.get(f.get("colorSpace", "rgb"), "interpolate")


def _tokens(text: str) -> Any:
    """``a {b} c`` as concat."""
    parts = [p for p in re.split(r"(\{[^{}]+\})", text) if p]
    if not any(p.startswith("{") for p in parts):
        return text
    return ["concat", *(["to-string", ["get", p[1:-1]]] if p.startswith("{") else p for p in parts)]
