"""SQL fragments for the DuckDB twins."""

from __future__ import annotations

CHANNELS = ("r", "g", "b", "a")


def clamp(v: str) -> str:
    return f"CAST(least(greatest({v}, 0), 255) AS INT)"


def byte(v: str) -> str:
    """A double rounded by truncation of v + 0.5, then clamped."""
    return clamp(f"trunc(({v}) + 0.5)")


def d255(v: str) -> str:
    return f"((({v}) + 1 + (({v}) >> 8)) >> 8)"


def point(source: str = "px", where: str = "", **channels: str) -> str:
    """Point operator: the named channels replaced."""
    cols = ", ".join(f"CAST({channels.get(c, c)} AS INT) AS {c}" for c in CHANNELS)
    return f"SELECT image_id, x, y, {cols} FROM {source} {where}"


def each(f, source: str = "px", over: str = "rgb", where: str = "") -> str:
    return point(source, where, **{c: f(c) for c in over})


def over(o: dict[str, str], u: dict[str, str], opaque: bool = False) -> dict[str, str]:
    oa = o["a"]
    out = {k: f"CASE WHEN {oa} = 255 THEN {o[k]} WHEN {oa} = 0 THEN {u[k]} ELSE " + d255(f"{o[k]} * {oa} + {u[k]} * (255 - {oa}) + 127") + " END" for k in "rgb"}
    out["a"] = "255" if opaque else f"CASE WHEN {oa} = 255 THEN 255 WHEN {oa} = 0 THEN {u['a']} ELSE {u['a']} + {oa} - {d255(u['a'] + ' * ' + oa)} END"
    return out


def over_pm(o: dict[str, str], u: dict[str, str]) -> dict[str, str]:
    oa = o["a"]
    out = {k: f"CASE WHEN {oa} = 255 THEN {o[k]} ELSE " + clamp(f"{o[k]} + " + d255(f"{u[k]} * (255 - {oa}) + 127")) + " END" for k in "rgb"}
    out["a"] = f"CASE WHEN {oa} = 255 THEN 255 ELSE {u['a']} + {oa} - {d255(u['a'] + ' * ' + oa)} END"
    return out
