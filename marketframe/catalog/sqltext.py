"""Short spellings for the window SQL the checks use over and over."""


def over(n: int, end: int = 0, keys: str = "asset_id", order: str = "ts") -> str:
    first = n - 1 - end
    last = f"{-end} PRECEDING" if end < 0 else ("CURRENT ROW" if end == 0 else f"{end} FOLLOWING")
    return f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS BETWEEN {first} PRECEDING AND {last})"


def roll(agg: str, x: str, n: int, end: int = 0, keys: str = "asset_id", least: int | None = None) -> str:
    w = over(n, end, keys)
    return f"(CASE WHEN COUNT({x}) {w} >= {n if least is None else least} THEN {agg}({x}) {w} END)"


W = "OVER (PARTITION BY asset_id ORDER BY ts)"
RUN = "OVER (PARTITION BY asset_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SHIFT = f"CAST(LAG(raw, 1, 0) {W} AS BIGINT) AS signal"


def changes(body: str, extra: str = "") -> str:
    """Change-only events from a subquery with (asset_id, ts, event[, extra columns])."""
    cols = f", {extra}" if extra else ""
    return f"""
        SELECT asset_id, ts, state AS direction{cols} FROM (
          SELECT *, LAG(state, 1, 'FLAT') {W} AS before FROM (
            SELECT *, COALESCE(LAST_VALUE(event IGNORE NULLS) {RUN}, 'FLAT') AS state FROM ({body})))
        WHERE state <> before"""
