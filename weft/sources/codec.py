"""Tagged JSON codec of dynamic values, for keyed tables whose values have no schema."""

from __future__ import annotations

import json
from datetime import datetime, timezone


def encode(value) -> str:
    """JSON text that decode() gives back: null, booleans, numbers with NaN and infinities, strings, lists, dicts, datetimes, exceptions."""
    return json.dumps(_tag(value), ensure_ascii=False, separators=(",", ":"))


def _tag(v):
    if v is None:
        return {"t": "null"}
    if isinstance(v, bool):
        return {"t": "boolean", "v": v}
    if isinstance(v, (int, float)):
        return {"t": "number", "v": repr(v)}
    if isinstance(v, str):
        return {"t": "string", "v": v}
    if isinstance(v, (list, tuple)):
        return {"t": "array", "v": [_tag(x) for x in v]}
    if isinstance(v, dict):
        return {"t": "object", "v": {str(k): _tag(x) for k, x in v.items()}}
    if isinstance(v, datetime):
        return {"t": "date", "v": v.astimezone(timezone.utc).isoformat(timespec="milliseconds")}
    if isinstance(v, BaseException):
        return {"t": "error", "v": {"name": type(v).__name__, "message": str(v)}}
    raise TypeError(f"no encoding for {type(v).__name__}")


def decode(text: str):
    if not isinstance(text, str):
        raise TypeError("not an encoded value")
    return _untag(json.loads(text))


def _untag(x):
    kind, v = x["t"], x.get("v")
    if kind == "number":
        return int(v) if v.lstrip("-").isdigit() else float(v)
    if kind == "array":
        return [_untag(y) for y in v]
    if kind == "object":
        return {k: _untag(y) for k, y in v.items()}
    if kind == "date":
        return datetime.fromisoformat(v)
    if kind == "error":
        return RuntimeError(v["message"])
    if kind in ("null", "boolean", "string"):
        return v
    raise ValueError(f"unknown tag {kind}")
