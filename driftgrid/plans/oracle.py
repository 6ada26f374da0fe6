"""SQL fragments shared by the comparison queries: the adapters and small helpers."""

from __future__ import annotations

from driftgrid.functions.columns import NUDGE

# name -> (what it builds on, body); the twin of ``sources.adapters``
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "px": ((), "SELECT vec_id, p::INT AS p, embedding[p + 1]::DOUBLE AS e FROM embeddings, range(64) r(p)"),
    "image8": (
        ("px",),
        "SELECT vec_id AS frame_id, (p // 8)::INT AS y, (p % 8)::INT AS x, 128 + 256 * e AS i FROM px",
    ),
    "field8": (
        ("px",),
        """SELECT vec_id // 2 AS frame_id, (p // 8)::INT AS y, (p % 8)::INT AS x,
                  max(CASE WHEN vec_id % 2 = 0 THEN 8 * e END) AS u,
                  max(CASE WHEN vec_id % 2 = 1 THEN 8 * e END) AS v
           FROM px GROUP BY ALL""",
    ),
    "truth8": (
        ("field8",),
        """SELECT (frame_id - 1 + n) % n AS frame_id, y, x, u, v
           FROM field8, (SELECT max(frame_id) + 1 AS n FROM field8)""",
    ),
    "pairs8": (
        ("field8", "truth8"),
        """SELECT f.frame_id, f.y, f.x, f.u, f.v, t.u AS tu, t.v AS tv
           FROM field8 f JOIN truth8 t USING (frame_id, y, x)""",
    ),
    "valid8": (
        ("field8",),
        "SELECT *, (frame_id * 131 + y * 17 + x * 7) % 23 <> 0 AS valid FROM field8",
    ),
    "spiky8": (
        ("valid8",),
        "SELECT frame_id, y, x, CASE WHEN valid THEN u ELSE 10 * u END AS u, v FROM valid8",
    ),
    "ensemble8": (
        ("field8",),
        """SELECT frame_id // 3 AS frame_id, (frame_id % 3)::INT AS estimator, y, x, u, v FROM field8""",
    ),
    "sequence8": (
        ("field8",),
        """SELECT *, frame_id // 25 AS seq_id, (frame_id % 25)::INT AS t,
                  (frame_id % 25) % 10 = 9 AS done, frame_id % 25 = 24 AS is_padding FROM field8""",
    ),
    "mosaic32": (
        ("px",),
        """SELECT g.vec_id // 16 AS frame_id,
                  ((g.vec_id % 16) // 4 * 8 + q.p // 8)::INT AS y, ((g.vec_id % 16) % 4 * 8 + q.p % 8)::INT AS x,
                  128 + 256 * px.e AS i
           FROM (SELECT unnest(range(0, (SELECT (max(vec_id) + 16) // 16 * 16 FROM embeddings))) AS vec_id) g
           CROSS JOIN range(64) q(p) JOIN px ON px.vec_id = g.vec_id % (SELECT max(vec_id) + 1 FROM embeddings) AND px.p = q.p""",
    ),
    "moved32": (
        ("mosaic32",),
        "SELECT frame_id, (y + 1) % 32 AS y, (x + 2) % 32 AS x, i FROM mosaic32",
    ),
    "mfield32": (
        ("mosaic32",),
        "SELECT frame_id, y, x, (i - 128) / 32 AS u, (128 - i) / 64 + 0.25 AS v FROM mosaic32",
    ),
    "masked8": (
        ("ensemble8", "field8"),
        """SELECT e.*, CASE WHEN sqrt((e.u - f.u) ** 2 + (e.v - f.v) ** 2) > 1.5 THEN 0.0 ELSE 1.0 END::DOUBLE AS mask
           FROM ensemble8 e JOIN field8 f USING (frame_id, y, x)""",
    ),
    "listed8": (
        ("ensemble8",),
        "SELECT *, ([1.0, 2.0, 0.5])[estimator + 1]::DOUBLE AS w FROM ensemble8",
    ),
}


def sql(views: str, body: str, *extra: tuple[str, str]) -> str:
    """A query on named views plus further common table expressions of its own."""
    order: list[str] = []

    def add(name: str) -> None:
        for base in VIEWS[name][0]:
            add(base)
        if name not in order:
            order.append(name)

    for name in views.split():
        add(name)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({b})" for n, b in extra]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def r6(expression: str, name: str | None = None) -> str:
    """Six decimals without negative zero."""
    return f"round({expression} + {NUDGE!r}, 6) + 0.0::DOUBLE" + (f" AS {name}" if name else "")


def around(table: str, columns: str, radius: int, default: str | None = "0.0", key: str = "frame_id") -> str:
    """Every pixel with every place of its window; outside values take the default."""
    picked = ", ".join(f"coalesce(b.{c}, {default}) AS {c}" if default else f"b.{c} AS {c}" for c in columns.split())
    kind = "LEFT JOIN" if default else "JOIN"
    return f"""SELECT a.{key}, a.y, a.x, dy, dx, {picked}
        FROM {table} a CROSS JOIN (SELECT unnest(range({-radius}, {radius + 1})) AS dy)
        CROSS JOIN (SELECT unnest(range({-radius}, {radius + 1})) AS dx)
        {kind} {table} b ON b.{key} = a.{key} AND b.y = a.y + dy AND b.x = a.x + dx"""


def bilinear_zero(table: str, points: str, value: str = "i", key: str = "frame_id") -> str:
    """``points`` (with ``yf, xf``) plus ``s``: bilinear value of the table, 0 outside."""
    corners = []
    for dy in (0, 1):
        for dx in (0, 1):
            wy = "(q.yf - floor(q.yf))" if dy else "(1 - (q.yf - floor(q.yf)))"
            wx = "(q.xf - floor(q.xf))" if dx else "(1 - (q.xf - floor(q.xf)))"
            corners.append((f"c{dy}{dx}", dy, dx, f"{wy} * {wx}"))
    total = " + ".join(f"{w} * coalesce({n}.{value}, 0.0)" for n, _, _, w in corners)
    joins = " ".join(
        f"LEFT JOIN {table} {n} ON {n}.{key} = q.{key} AND {n}.y = floor(q.yf) + {dy} AND {n}.x = floor(q.xf) + {dx}"
        for n, dy, dx, _ in corners
    )
    return f"SELECT q.*, {total} AS s FROM {points} q {joins}"


def bilinear_clamped(table: str, points: str, shape: tuple[int, int], columns: str = "i", key: str = "frame_id") -> str:
    """``points`` (with ``yf, xf``) plus ``s_<column>``, positions clamped into the frame."""
    h, w = shape
    y, x = f"least(greatest(q.yf, 0.0), {h - 1}.0)", f"least(greatest(q.xf, 0.0), {w - 1}.0)"
    wy, wx = f"({y} - floor({y}))", f"({x} - floor({x}))"
    picked = ", ".join(
        f"(1 - {wx}) * (1 - {wy}) * a.{c} + {wx} * (1 - {wy}) * b.{c} + (1 - {wx}) * {wy} * c.{c} + {wx} * {wy} * d.{c} AS s_{c}"
        for c in columns.split()
    )
    joins = " ".join(
        f"JOIN {table} {n} ON {n}.{key} = q.{key} AND {n}.y = least(floor({y}) + {dy}, {h - 1}) AND {n}.x = least(floor({x}) + {dx}, {w - 1})"
        for n, dy, dx in (("a", 0, 0), ("b", 0, 1), ("c", 1, 0), ("d", 1, 1))
    )
    return f"SELECT q.*, {picked} FROM {points} q {joins}"


def resize_sql(table: str, columns: str, shape: tuple[int, int], new: tuple[int, int], key: str = "frame_id") -> str:
    """Bilinear resize with half-pixel centres and clamped borders."""
    grid = f"""(SELECT {key}, oy::INT AS y, ox::INT AS x,
        (oy + 0.5) * {shape[0] / new[0]!r} - 0.5 AS yf, (ox + 0.5) * {shape[1] / new[1]!r} - 0.5 AS xf
        FROM (SELECT DISTINCT {key} FROM {table}) CROSS JOIN range({new[0]}) r1(oy) CROSS JOIN range({new[1]}) r2(ox))"""
    picked = ", ".join(f"s_{c} AS {c}" for c in columns.split())
    return f"SELECT {key}, y, x, {picked} FROM ({bilinear_clamped(table, grid, shape, columns, key)})"


def sobel_sql(table: str, value: str = "i") -> str:
    """Zero-padded Sobel gradients ``ix, iy``."""
    return f"""SELECT frame_id, y, x,
        sum(0.125 * dx * (2 - abs(dy)) * {value}) AS ix, sum(0.125 * dy * (2 - abs(dx)) * {value}) AS iy
        FROM ({around(table, value, 1)}) GROUP BY ALL"""


def relaxed_sql(table: str, rounds: int) -> tuple[tuple[str, str], tuple[str, str], tuple[str, str]]:
    """CTE ``rl``: Jacobi relaxation of an 8x8 ``table`` with ``valid``, frames held as lists."""

    def step(c: str) -> str:
        near = " + ".join(
            f"{c}[(least(greatest(i // 8 + ({dy}), 0), 7) * 8 + least(greatest(i % 8 + ({dx}), 0), 7) + 1)::INT]"
            for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))
        )
        return f"list_transform(range(64), lambda i: CASE WHEN ok[i + 1] THEN {c}[i + 1] ELSE ({near}) / 4 END)"

    packed = f"SELECT frame_id, " + ", ".join(
        f"list({c} ORDER BY y, x) AS {n}" for c, n in (("u", "u"), ("v", "v"), ("valid", "ok"))
    ) + f" FROM {table} GROUP BY frame_id"
    walk = f"SELECT 0 AS k, frame_id, u, v, ok FROM rp UNION ALL SELECT k + 1, frame_id, {step('u')}, {step('v')}, ok FROM rw WHERE k < {rounds}"
    flat = f"""SELECT frame_id, (p // 8)::INT AS y, (p % 8)::INT AS x, u[p + 1] AS u, v[p + 1] AS v
        FROM rw CROSS JOIN range(64) r(p) WHERE k = {rounds}"""
    return ("rp", packed), ("rw", walk), ("rl", flat)
