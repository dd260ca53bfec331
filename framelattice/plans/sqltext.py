"""Building blocks for the checking SQL."""

from __future__ import annotations


def cl(e: str, lo: str = "0e0", hi: str = "1e0") -> str:
    return f"least(greatest({e},{lo}),{hi})"


def on(a: str, b: str, keys=("clip_id", "frame_no")) -> str:
    return " AND ".join(f"{a}.{k}={b}.{k}" for k in keys)


def bilinear(name: str, queries: str, source: str, values: dict[str, str], sx: str, sy: str, w, h,
             keys=("clip_id", "frame_no"), reject: bool = False, flag: str | None = None, how: str = "LEFT JOIN") -> str:
    """CTE ``name``: the rows of ``queries`` with clamped bilinear values of ``source``."""
    def val(c: str) -> str:
        top, bot = f"(a.{c}+(b.{c}-a.{c})*_tx)", f"(c.{c}+(d.{c}-c.{c})*_tx)"
        return f"({top}+({bot}-{top})*_ty)"

    ok = f"(_sx>=0 AND _sy>=0 AND _sx<={w}-1 AND _sy<={h}-1)"
    outs = ", ".join(f"CASE WHEN {ok} THEN {val(c)} END AS {n}" if reject else f"{val(c)} AS {n}" for c, n in values.items())
    corners = " ".join(
        f"{how} {source} {t} ON {on(t, 'q', keys)} AND {t}.y=q.{yy} AND {t}.x=q.{xx}"
        for t, yy, xx in (("a", "_y0", "_x0"), ("b", "_y0", "_x1"), ("c", "_y1", "_x0"), ("d", "_y1", "_x1")))
    hidden = "_sx,_sy,_cx,_cy,_x0,_y0,_x1,_y1,_tx,_ty"
    return f"""{name} AS (SELECT q.* EXCLUDE ({hidden}), {outs}{f', {ok} AS {flag}' if flag else ''} FROM
 (SELECT *, least(_x0+1,{w}-1) AS _x1, least(_y0+1,{h}-1) AS _y1, _cx-_x0 AS _tx, _cy-_y0 AS _ty FROM
 (SELECT *, CAST(floor(_cx) AS BIGINT) AS _x0, CAST(floor(_cy) AS BIGINT) AS _y0 FROM
 (SELECT *, {cl('_sx', '0e0', f'{w}-1e0')} AS _cx, {cl('_sy', '0e0', f'{h}-1e0')} AS _cy FROM
 (SELECT *, CAST({sx} AS DOUBLE) AS _sx, CAST({sy} AS DOUBLE) AS _sy FROM {queries})))) q {corners})"""


def filled(base: str, found: str, base_cols: list[str], found_cols: list[str], keys=("clip_id", "frame_no", "y", "x")) -> str:
    """Every row of ``base`` with the columns of ``found``, null where it has none: a union by key, no outer join."""
    k = ", ".join(keys)
    gap = lambda cols: "".join(f", NULL AS {c}" for c in cols)
    has = lambda cols: "".join(f", {c}" for c in cols)
    top = "".join(f", max({c}) AS {c}" for c in [*base_cols, *found_cols])
    return (f"SELECT {k}{top} FROM (SELECT {k}, true AS _base{has(base_cols)}{gap(found_cols)} FROM {base} "
            f"UNION ALL SELECT {k}, false{gap(base_cols)}{has(found_cols)} FROM {found}) GROUP BY {k} HAVING bool_or(_base)")


def nine_join(name: str, source: str, select: str, w, h, keys=("clip_id", "frame_no"), edge: str = "clamp") -> str:
    """CTE ``name``: aggregates over the 3x3 neighbours n of each cell c (offsets o.dy, o.dx)."""
    if edge == "clamp":
        yy, xx = f"least(greatest(c.y+o.dy,0),{h}-1)", f"least(greatest(c.x+o.dx,0),{w}-1)"
    else:
        m = lambda v, n: f"CASE WHEN {v}<0 THEN -({v}) WHEN {v}>{n}-1 THEN 2*({n}-1)-({v}) ELSE {v} END"
        yy, xx = m("c.y+o.dy", h), m("c.x+o.dx", w)
    ks = ", ".join(f"c.{k}" for k in keys)
    return f"""{name} AS (SELECT {ks}, c.y, c.x, {select} FROM {source} c
 CROSS JOIN (SELECT j-1 AS dy, i-1 AS dx FROM range(3) a(j), range(3) b(i)) o
 JOIN {source} n ON {on('n', 'c', keys)} AND n.y={yy} AND n.x={xx} GROUP BY {ks}, c.y, c.x)"""


def previous(name: str, source: str, by: int = 1) -> str:
    """CTE ``name``: ``source`` keyed to the frame that reads it."""
    return f"{name} AS (SELECT * REPLACE (frame_no+{by} AS frame_no) FROM {source})"


LUMA = "(2126*r+7152*g+722*b)/10000e0"
