"""SQL text of small matrix expressions, for checking operators against another engine. Every function returns a query in parentheses over (i, j, v)."""

from __future__ import annotations


def eye(n: int) -> str:
    return f"(SELECT r AS i, r AS j, 1.0::DOUBLE AS v FROM (SELECT unnest(range({n})) AS r))"


def t(a: str) -> str:
    return f"(SELECT j AS i, i AS j, v FROM {a})"


def mm(a: str, b: str) -> str:
    return f"(SELECT x.i, y.j, sum(x.v * y.v) AS v FROM {a} x JOIN {b} y ON x.j = y.i GROUP BY x.i, y.j)"


def add(*terms: tuple[float, str]) -> str:
    return "(SELECT i, j, sum(v) AS v FROM (" + " UNION ALL ".join(f"SELECT i, j, ({c}) * v AS v FROM {a}" for c, a in terms) + ") GROUP BY i, j)"


def scale(c: float, a: str) -> str:
    return f"(SELECT i, j, ({c}) * v AS v FROM {a})"


def where(a: str, condition: str) -> str:
    return f"(SELECT i, j, v FROM {a} WHERE {condition})"


def tri(a: str, uplo: str, unit: bool = False, n: int = 0) -> str:
    if unit:
        return f"(SELECT i, j, v FROM {a} WHERE {'j < i' if uplo == 'L' else 'j > i'} UNION ALL SELECT i, j, v FROM {eye(n)})"
    return where(a, "j <= i" if uplo == "L" else "j >= i")


def part(a: str, r0: int, r1: int, c0: int, c1: int) -> str:
    return f"(SELECT i - {r0} AS i, j - {c0} AS j, v FROM {a} WHERE i >= {r0} AND i < {r1} AND j >= {c0} AND j < {c1})"


def flip(a: str, n: int, rows: bool = True, columns: bool = True) -> str:
    return f"(SELECT {f'{n - 1} - i' if rows else 'i'} AS i, {f'{n - 1} - j' if columns else 'j'} AS j, v FROM {a})"


def lists(a: str, m: int, n: int) -> str:
    """(i, r): the rows as lists, zeros filled in."""
    grid = f"(SELECT p AS i, q AS j FROM (SELECT unnest(range({m})) AS p), (SELECT unnest(range({n})) AS q))"
    return f"(SELECT g.i, list(coalesce(a.v, 0.0) ORDER BY g.j) AS r FROM {grid} g LEFT JOIN {a} a ON a.i = g.i AND a.j = g.j GROUP BY g.i)"


def forward(a: str, b: str, n: int, columns: int) -> str:
    """X with A X = B for a lower triangular A: one recursion step a row."""
    return (
        f"(WITH RECURSIVE ra AS (SELECT i, r FROM {lists(a, n, n)}), cb AS (SELECT i AS c, r FROM {lists(t(b), columns, n)}), "
        "s AS (SELECT c, 0::BIGINT AS k, []::DOUBLE[] AS x FROM cb UNION ALL "
        "SELECT s.c, s.k + 1, list_append(s.x, (cb.r[s.k + 1] - coalesce(list_sum(list_transform(range(1, s.k + 1), lambda q: ra.r[q] * s.x[q])), 0)) / ra.r[s.k + 1]) "
        f"FROM s JOIN cb ON cb.c = s.c JOIN ra ON ra.i = s.k WHERE s.k < {n}) "
        f"SELECT u.i, s.c AS j, s.x[u.i + 1] AS v FROM s, (SELECT unnest(range({n})) AS i) u WHERE s.k = {n})"
    )


def solve(side: str, uplo: str, trans: bool, unit: bool, a: str, b: str, n: int, other: int) -> str:
    """X with op(A) X = B (n x other), or X op(A) = B (other x n): all are forward substitutions after turning."""
    x = tri(a, uplo, unit, n)
    lower = uplo == "L"
    if trans:
        x, lower = t(x), not lower
    if side == "R":
        x, lower, b = t(x), not lower, t(b)
    out = forward(x, b, n, other) if lower else flip(forward(flip(x, n), flip(b, n, True, False), n, other), n, True, False)
    return t(out) if side == "R" else out


def lu(a: str, n: int, pivot: str = "none", last: bool = False) -> str:
    """(m, p, q) in one row: packed L and U as a list of lists, row and column order (0-based): one recursion step a pivot."""
    swap = lambda y: f"list_transform(range(1, {n + 1}), lambda w: CASE WHEN w = k + 1 THEN {y} WHEN w = {y} THEN k + 1 ELSE w END)"
    rows = f"list_filter(range(1, {n + 1}), lambda w: w > k)"
    if pivot == "row_max":
        pick_p, pick_q = f"k + list_position(list_transform({rows}, lambda w: abs(m[w][k + 1])), list_max(list_transform({rows}, lambda w: abs(m[w][k + 1]))))", "k + 1"
    elif pivot == "row_nonzero":
        pick_p, pick_q = f"k + list_position(list_transform({rows}, lambda w: m[w][k + 1] <> 0), true)", "k + 1"
    elif pivot == "complete":
        flat = f"flatten(list_transform({rows}, lambda w: list_transform({rows}, lambda z: abs(m[w][z]))))"
        # Of equal candidates the first, or the last, in the order of columns within rows.
        place = f"list_position({flat}, list_max({flat})) - 1" if not last else f"len({flat}) - list_position(list_reverse({flat}), list_max({flat}))"
        pick_p, pick_q = f"k + 1 + ({place}) // ({n} - k)", f"k + 1 + ({place}) % ({n} - k)"
    else:
        pick_p, pick_q = "k + 1", "k + 1"
    return (
        f"(WITH RECURSIVE z AS (SELECT 0::BIGINT AS k, (SELECT list(r ORDER BY i) FROM {lists(a, n, n)}) AS m, range({n}) AS p, range({n}) AS q UNION ALL "
        f"SELECT k + 1, list_transform(range(1, {n + 1}), lambda a: list_transform(range(1, {n + 1}), lambda b: CASE WHEN a > k + 1 AND b > k + 1 THEN m[a][b] - m[a][k + 1] / m[k + 1][k + 1] * m[k + 1][b] "
        "WHEN a > k + 1 AND b = k + 1 THEN m[a][b] / m[k + 1][k + 1] ELSE m[a][b] END)), p, q FROM ("
        f"SELECT k, list_transform(sp, lambda w: list_transform(sq, lambda c: m[w][c])) AS m, list_transform(sp, lambda w: p[w]) AS p, list_transform(sq, lambda w: q[w]) AS q FROM ("
        f"SELECT k, m, p, q, {swap('pp')} AS sp, {swap('qq')} AS sq FROM (SELECT k, m, p, q, {pick_p} AS pp, {pick_q} AS qq FROM z WHERE k < {n})))) "
        f"SELECT m, p, q FROM z WHERE k = {n})"
    )


def packed(a: str, n: int, pivot: str = "none", last: bool = False) -> str:
    return f"(SELECT x.i, y.j, z.m[x.i + 1][y.j + 1] AS v FROM {lu(a, n, pivot, last)} z, (SELECT unnest(range({n})) AS i) x, (SELECT unnest(range({n})) AS j) y)"


def cholesky(g: str, n: int) -> str:
    """R with Rᵀ R = G and a positive diagonal, from G = L D Lᵀ."""
    return f"(WITH f AS (SELECT * FROM {packed(g, n)}) SELECT f.i, f.j, f.v / sqrt(d.v) AS v FROM f JOIN f d ON d.i = f.i AND d.j = f.i WHERE f.j >= f.i)"


def result(a: str) -> str:
    """Rounded non-zero entries with int indices."""
    return f"SELECT i::INT AS i, j::INT AS j, round(v, 6) AS v FROM {a} WHERE round(v, 6) <> 0"
