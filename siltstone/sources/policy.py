"""The policy: a TOML text with defaults for what is missing or can't be used."""

from __future__ import annotations

import json
import tomllib

# Defaults.
DEFAULTS: dict[str, object] = {
    "paths": [],
    "exclude": [],
    "keep_snaps": 1,
    "keep_daily": 0,
    "keep_weekly": 0,
    "keep_monthly": 0,
    "keep_yearly": 0,
    "auto_pack": True,
    "auto_gc": True,
    "auto_prune": True,
    "verify_after": False,
    "strict_meta": False,
}


def effective(text: str) -> dict[str, object]:
    """The policy of a TOML text. Values of another type, and negative numbers, leave the default."""
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        given = {}
    out = {}
    for key, default in DEFAULTS.items():
        value = given.get(key, default)
        fine = type(value) is type(default) and (not isinstance(value, int) or value >= 0)
        if isinstance(value, list):
            fine = fine and all(isinstance(x, str) for x in value)
        out[key] = value if fine else default
    return out


def dump(policy: dict[str, object]) -> str:
    """TOML of a policy; JSON's forms of these values are TOML's too."""
    return "".join(f"{k} = {json.dumps(policy.get(k, v), ensure_ascii=False)}\n" for k, v in DEFAULTS.items())
