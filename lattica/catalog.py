"""The queries of the linear-algebra operators over the given tables, each with the SQL that another engine checks it by."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import sqltext as S
from lattica.functions.number import rounded
from lattica.matrix import Matrix
from lattica.operators import gemm, lu, pentagon, qr, reflectors, triangular, vector
from lattica.plans.lineage import shared_folder
from lattica.sources import parquet
from lattica.streaming.gram import streaming_gram
from lattica.types import lamch

Build = Callable[[SparkSession, str], Matrix]


@dataclass(frozen=True)
class Input:
    """A matrix as a DataFrame and as SQL."""

    build: Build
    sql: str

    def __call__(self, spark: SparkSession, d: str) -> Matrix:
        return self.build(spark, d)

    @property
    def T(self) -> "Input":  # noqa: N802
        return Input(lambda s, d: self(s, d).T, S.t(self.sql))

    def __matmul__(self, other: "Input") -> "Input":
        return Input(lambda s, d: gemm.multiply(self(s, d), other(s, d)), S.mm(self.sql, other.sql))

    def __add__(self, other: "Input") -> "Input":
        return Input(lambda s, d: self(s, d).add(other(s, d)), S.add((1, self.sql), (1, other.sql)))

    def scaled(self, c: float) -> "Input":
        return Input(lambda s, d: self(s, d).scale(c), S.scale(c, self.sql))

    def tri(self, uplo: str) -> "Input":
        return Input(lambda s, d: self(s, d).tri(uplo), S.tri(self.sql, uplo))


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


def emb(r0: int, nr: int, c0: int, nc: int) -> Input:
    """A slice: rows r0.. and columns c0.. of the embeddings; the row filter reaches the Parquet scan."""

    def build(spark: SparkSession, d: str) -> Matrix:
        df = read(spark, d, "embeddings").where((F.col("vec_id") >= r0) & (F.col("vec_id") < r0 + nr))
        df = df.select((F.col("vec_id") - r0).alias("k"), F.slice("embedding", c0 + 1, nc).alias("a"))
        return Matrix.from_rows(df, "k", "a", nc, nr)

    return Input(build, S.part(E.sql, r0, r0 + nr, c0, c0 + nc))


def fold(r0: int, nr: int, c0: int, nc: int) -> Input:
    """An nr x nc matrix of all elements of the embeddings: element (i, j) is a weighted sum of the rows and columns that fall on it, over the root of their number.

    Rows fall on (vec_id + r0) modulo nr, columns on (c + c0) modulo nc, and the weights follow from r0 and c0 too, so different ones make different matrices.
    The sums are combined in the tasks that read the table.
    """
    row, column = f"(vec_id + {r0}) % {nr}", f"(c + {c0}) % {nc}"
    weight = f"(12 + (3 * vec_id + {r0}) % 13) * (10 + (7 * c + {c0}) % 11)"  # from 120 to 480

    def build(spark: SparkSession, d: str) -> Matrix:
        e = read(spark, d, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("c", "x"))
        e = e.groupBy(F.expr(row).alias("i"), F.expr(column).alias("j")).agg((F.sum(F.expr(f"{weight} * x")) / (480 * F.sqrt(F.count("*")))).alias("v"))
        return Matrix.from_entries(e, nr, nc)

    terms = "SELECT vec_id, u.c, embedding[u.c + 1]::DOUBLE AS x FROM embeddings, (SELECT unnest(range(64)) AS c) u"
    return Input(build, f"(SELECT {row} AS i, {column} AS j, sum({weight} * x) / (480 * sqrt(count(*))) AS v FROM ({terms}) GROUP BY ALL)")


def folded(n: int) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """(rows as cells ``a`` of n numbers, SQL): all embeddings, column c added to column c modulo n."""

    def rows(spark: SparkSession, d: str) -> DataFrame:
        cells = [sum((F.col("embedding")[c].cast("double") for c in range(j + n, 64, n)), F.col("embedding")[j].cast("double")) for j in range(n)]
        return read(spark, d, "embeddings").select("vec_id", F.array(*cells).alias("a"))

    return rows, f"(SELECT i, j % {n} AS j, sum(v) AS v FROM {E.sql} GROUP BY ALL)"


def eye(n: int) -> Input:
    return Input(lambda s, d: Matrix.identity(s, n), S.eye(n))


def _whole(spark: SparkSession, d: str) -> Matrix:
    df = read(spark, d, "embeddings")
    return Matrix.from_rows(df, "vec_id", "embedding", 64, int(df.agg(F.max("vec_id")).first()[0]) + 1)


E = Input(_whole, "(SELECT vec_id AS i, u.c AS j, embedding[u.c + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS c) u)")
#: Well-conditioned squares of order 8, and one whose pivots must be searched for.
S8 = fold(0, 64, 0, 8).T @ fold(0, 64, 0, 8) + eye(8)
N8 = fold(0, 8, 0, 8) + eye(8).scaled(2)
P8 = Input(lambda s, d: N8(s, d).permute(s.range(8).select(F.col("id").alias("k"), (7 - F.col("id")).alias("src"))), S.flip(N8.sql, 8, True, False))
B85, B58 = fold(10, 8, 0, 5), fold(20, 5, 0, 8)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str) -> None:
    QUERIES[name], ORACLES[name] = query, sql


def matrix(name: str, build: Build, sql: str) -> None:
    """A query that returns a matrix's rounded non-zero entries."""
    register(name, lambda s, d: build(s, d).compact(), S.result(sql))


# -- elements, shapes, constants ----------------------------------------------------------------------------------

register("size", lambda s, d: s.createDataFrame([(a := E(s, d)).size() + (len(a),)], "m long, n long, length long"), "SELECT (max(vec_id) + 1)::BIGINT AS m, 64::BIGINT AS n, ((max(vec_id) + 1) * 64)::BIGINT AS length FROM embeddings")
register("getindex", lambda s, d: s.createDataFrame([("pair", round(S8(s, d)[2, 5], 6)), ("linear", round(S8(s, d)[2 + 8 * 5], 6))], "what string, v double"), f"SELECT w.what, round(v, 6) AS v FROM {S8.sql}, (VALUES ('pair'), ('linear')) w(what) WHERE i = 2 AND j = 5")
matrix("setindex", lambda s, d: N8(s, d).with_element((1, 2), 7.5).with_element(3 + 8 * 4, -1.25), f"(SELECT i, j, CASE WHEN i = 1 AND j = 2 THEN 7.5 WHEN i = 3 AND j = 4 THEN -1.25 ELSE v END AS v FROM {N8.sql} UNION ALL SELECT * FROM (VALUES (1, 2, 7.5::DOUBLE), (3, 4, -1.25::DOUBLE)) x(i, j, v) WHERE NOT EXISTS (SELECT 1 FROM {N8.sql} n WHERE n.i = x.i AND n.j = x.j))")
register("lamch", lambda s, d: s.createDataFrame([(f"{t}{w}", float(np.round(np.log2(lamch(t, w)), 6))) for t in ("float32", "float64") for w in "ESP"], "what string, log2 double"), "SELECT * FROM (VALUES ('float32E', -24.0::DOUBLE), ('float32S', -126.0), ('float32P', -23.0), ('float64E', -53.0), ('float64S', -1022.0), ('float64P', -52.0)) x(what, log2)")
for u, unit in product("LU", (False, True)):
    a = fold(0, 8, 0, 6)
    matrix(f"trapezoid_{u.lower()}{'_unit' if unit else ''}", lambda s, d, u=u, unit=unit, a=a: triangular.trapezoid(u, a(s, d), "U" if unit else "N"), S.tri(a.sql, u, unit, 6))
_gap = Input(lambda s, d: fold(0, 6, 0, 6)(s, d).where((F.col("i") < 4) & (F.col("j") < 3)), S.where(fold(0, 6, 0, 6).sql, "i < 4 AND j < 3"))
register("last_nonzero_row", lambda s, d: _gap(s, d).last_nonzero_row(), f"SELECT coalesce(max(i) + 1, 0)::INT AS last FROM {_gap.sql} WHERE v <> 0")
register("last_nonzero_column", lambda s, d: _gap(s, d).last_nonzero_column(), f"SELECT coalesce(max(j) + 1, 0)::INT AS last FROM {_gap.sql} WHERE v <> 0")
matrix("transpose", lambda s, d: E(s, d).T, S.t(E.sql))
matrix("slice_block", lambda s, d: E(s, d).slice((10, 42), (8, 24)), S.part(E.sql, 10, 42, 8, 24))
matrix("slice_pushed", emb(10, 32, 8, 16), emb(10, 32, 8, 16).sql)
matrix("strided", lambda s, d: E(s, d).strided(7), f"(SELECT i // 7 AS i, j, v FROM {E.sql} WHERE i % 7 = 0)")
for name, method, sql in (("fro_norm", Matrix.fro_norm, f"sqrt(sum(v * v)) FROM {E.sql}"), ("one_norm", Matrix.one_norm, f"max(x) FROM (SELECT sum(abs(v)) AS x FROM {E.sql} GROUP BY j)"), ("inf_norm", Matrix.inf_norm, f"max(x) FROM (SELECT sum(abs(v)) AS x FROM {E.sql} GROUP BY i)")):
    select, _, rest = sql.partition(" FROM ")
    register(name, lambda s, d, method=method: method(E(s, d)).select(rounded(F.col("norm")).alias("norm")), f"SELECT round({select}, 6) AS norm FROM {rest}")

# -- vectors and rank-1 updates -----------------------------------------------------------------------------------


def _part(column: str) -> Input:
    def build(spark: SparkSession, d: str) -> Matrix:
        df = read(spark, d, "part").select(F.col("p_partkey").alias("i"), F.lit(0).alias("j"), F.col(column).cast("double").alias("v"))
        return Matrix.from_entries(df, int(df.agg(F.max("i")).first()[0]) + 1, 1)

    return Input(build, f"(SELECT p_partkey AS i, 0 AS j, {column}::DOUBLE AS v FROM part)")


x_part, y_part = _part("p_size"), _part("p_retailprice")
matrix("axpy", lambda s, d: vector.axpy(0.7, x_part(s, d), y_part(s, d)), S.add((0.7, x_part.sql), (1, y_part.sql)))
register("dot", lambda s, d: vector.dot(x_part(s, d), y_part(s, d)).df.select(F.round("v", 2).alias("v")), "SELECT round(sum(p_size::DOUBLE * p_retailprice), 2) AS v FROM part")
matrix("gemv_n", lambda s, d: (lambda e: vector.gemv("N", 1.5, e, fold(3, 1, 0, 64)(s, d).T, 0.5, e.slice((0, e.m), (1, 2))))(E(s, d)), S.add((1.5, S.mm(E.sql, fold(3, 1, 0, 64).T.sql)), (0.5, f"(SELECT i, 0 AS j, v FROM {E.sql} WHERE j = 1)")))
matrix("gemv_t", lambda s, d: (lambda e: vector.gemv("T", 1, e, e.slice((0, e.m), (0, 1))))(E(s, d)), S.mm(E.T.sql, f"(SELECT i, 0 AS j, v FROM {E.sql} WHERE j = 0)"))
x8, y5 = fold(1, 1, 0, 8).T, fold(2, 1, 0, 5).T
matrix("ger", lambda s, d: vector.geru(0.7, x8(s, d), y5(s, d), B85(s, d)), S.add((1, B85.sql), (0.7, S.mm(x8.sql, y5.T.sql))))


def complexed(re: Input, im: Input) -> Build:
    def build(spark: SparkSession, d: str) -> Matrix:
        return re(spark, d).to_complex().add(im(spark, d).scale(1j))

    return build


def complex_sql(re: str, im: str) -> str:
    terms = f"SELECT i, j, v AS re, 0.0 AS im FROM {re} UNION ALL SELECT i, j, 0.0 AS re, v AS im FROM {im}"
    return f"SELECT i::INT AS i, j::INT AS j, re, im FROM (SELECT i, j, CASE WHEN round(sum(re), 6) = 0 THEN 0.0 ELSE round(sum(re), 6) END AS re, CASE WHEN round(sum(im), 6) = 0 THEN 0.0 ELSE round(sum(im), 6) END AS im FROM ({terms}) GROUP BY i, j) WHERE re <> 0 OR im <> 0"


def complex_matrix(name: str, build: Build, re: str, im: str) -> None:
    register(name, lambda s, d: build(s, d).compact(), complex_sql(re, im))


def cmm(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    return S.add((1, S.mm(a[0], b[0])), (-1, S.mm(a[1], b[1]))), S.add((1, S.mm(a[0], b[1])), (1, S.mm(a[1], b[0])))


def cadj(a: tuple[str, str]) -> tuple[str, str]:
    return S.t(a[0]), S.scale(-1, S.t(a[1]))


def cadd(alpha: complex, a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str]:
    """b + alpha a."""
    p, q = alpha.real, alpha.imag
    return S.add((1, b[0]), (p, a[0]), (-q, a[1])), S.add((1, b[1]), (p, a[1]), (q, a[0]))


def cpair(r0: int, nr: int, nc: int) -> tuple[Build, tuple[str, str]]:
    re, im = fold(r0, nr, 0, nc), fold(r0, nr, 32, nc)
    return complexed(re, im), (re.sql, im.sql)


(ca, sa), (cb, sb), (cc, sc) = cpair(0, 12, 6), cpair(20, 6, 9), cpair(40, 12, 9)
(cx, sx), (cy, sy), (cd, sd) = cpair(60, 12, 1), cpair(80, 9, 1), cpair(100, 12, 6)
complex_matrix("axpy_complex", lambda s, d: vector.axpy(0.7 + 0.3j, cx(s, d), cpair(120, 12, 1)[0](s, d)), *cadd(0.7 + 0.3j, sx, cpair(120, 12, 1)[1]))
complex_matrix("gerc", lambda s, d: vector.gerc(0.7 + 0.3j, cx(s, d), cy(s, d), cc(s, d)), *cadd(0.7 + 0.3j, cmm(sx, cadj(sy)), sc))
complex_matrix("geru", lambda s, d: vector.geru(0.7 + 0.3j, cx(s, d), cy(s, d), cc(s, d)), *cadd(0.7 + 0.3j, cmm(sx, (S.t(sy[0]), S.t(sy[1]))), sc))
complex_matrix("complex_gemm_nn", lambda s, d: gemm.gemm("N", "N", 0.5 - 1j, ca(s, d), cb(s, d), 1, cc(s, d)), *cadd(0.5 - 1j, cmm(sa, sb), sc))
complex_matrix("complex_gemm_cn", lambda s, d: gemm.gemm("C", "N", 1, ca(s, d), cc(s, d)), *cmm(cadj(sa), sc))
complex_matrix("complex_gemm_nc", lambda s, d: gemm.gemm("N", "C", 1, ca(s, d), cd(s, d)), *cmm(sa, cadj(sd)))
for u in "UL":
    cond = "j >= i" if u == "U" else "j <= i"
    h = cmm(sa, cadj(sa))
    complex_matrix(f"herk_{u.lower()}", lambda s, d, u=u: gemm.herk(u, "N", 2, ca(s, d)), *(S.where(S.scale(2, p), cond) for p in h))
    h2 = cadd(0.5 + 1j, cmm(sa, cadj(sd)), cadd(0.5 - 1j, cmm(sd, cadj(sa)), (S.scale(0, sa[0]), S.scale(0, sa[0]))))
    complex_matrix(f"her2k_{u.lower()}", lambda s, d, u=u: gemm.her2k(u, "N", 0.5 + 1j, ca(s, d), cd(s, d)), *(S.where(p, cond) for p in h2))

# -- products -----------------------------------------------------------------------------------------------------

W1, W2, W3 = fold(0, 40, 0, 24), fold(50, 24, 0, 30), fold(100, 40, 0, 30)
for ta, tb in product("NT", "NT"):
    p, q = (W1 if ta == "N" else W1.T), (W2 if tb == "N" else W2.T)
    matrix(f"gemm_{ta}{tb}".lower(), lambda s, d, p=p, q=q, ta=ta, tb=tb: gemm.gemm(ta, tb, 2.0, p(s, d), q(s, d), 0.5, W3(s, d)), S.add((2.0, S.mm(W1.sql, W2.sql)), (0.5, W3.sql)))
matrix("gemm_add", lambda s, d: gemm.gemm_add(W1(s, d), W2(s, d), W3(s, d)), S.add((1, S.mm(W1.sql, W2.sql)), (1, W3.sql)))
matrix("gemm_sub", lambda s, d: gemm.gemm_sub(W3(s, d), W1(s, d), W2(s, d)), S.add((-1, S.mm(W1.sql, W2.sql)), (1, W3.sql)))


def _blocks(spark: SparkSession, d: str) -> Matrix:
    from lattica.operators.block import BlockMatrix

    e = E(spark, d)
    return BlockMatrix.from_matrix(e.T, 32).multiply(BlockMatrix.from_matrix(e, 32)).to_matrix()


matrix("gemm_block", _blocks, S.mm(E.T.sql, E.sql))
matrix("gram_emb", lambda s, d: gemm.tall_gram(read(s, d, "embeddings"), "embedding", 64), S.mm(E.T.sql, E.sql))
matrix("gram_emb_join", lambda s, d: (lambda e: gemm.gemm("T", "N", 1, e, e))(E(s, d)), S.mm(E.T.sql, E.sql))
for u in "UL":
    cond = "j >= i" if u == "U" else "j <= i"
    matrix(f"syrk_{u.lower()}", lambda s, d, u=u: gemm.syrk(u, "T", 1.5, E(s, d), 0.5, S64(s, d)), S.where(S.add((2.0, S.mm(E.T.sql, E.sql)), (0.5, S.eye(64))), cond))
    matrix(f"syr2k_{u.lower()}", lambda s, d, u=u: gemm.syr2k(u, "N", 1.5, W1(s, d), fold(200, 40, 0, 24)(s, d)), S.where(S.add((1.5, S.mm(W1.sql, fold(200, 40, 0, 24).T.sql)), (1.5, S.mm(fold(200, 40, 0, 24).sql, W1.T.sql))), cond))
S64 = E.T @ E + eye(64)

MONEY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _exact_gram(spark: SparkSession, d: str) -> DataFrame:
    df = read(spark, d, "lineitem").select(*(F.col(c).cast("decimal(18,2)").alias(c) for c in MONEY))
    terms = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}{j}") for i, a in enumerate(MONEY) for j, b in enumerate(MONEY) if j >= i]
    wide = df.agg(*terms)
    cells = ", ".join(f"{i}, {j}, g{i}{j}" for i in range(4) for j in range(4) if j >= i)
    return wide.selectExpr(f"stack(10, {cells}) AS (i, j, v)").select(F.col("i").cast("int"), F.col("j").cast("int"), F.col("v").cast("decimal(38,4)").alias("v"))


register("gram_lineitem_exact", _exact_gram, " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, sum({a}::DECIMAL(18,2) * {b}::DECIMAL(18,2))::DECIMAL(38,4) AS v FROM lineitem" for i, a in enumerate(MONEY) for j, b in enumerate(MONEY) if j >= i))
register("nation_priority", lambda s, d: read(s, d, "orders").join(read(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").cast("int").alias("i"), F.col("o_orderpriority").alias("priority")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v")), "SELECT c_nationkey::INT AS i, o_orderpriority AS priority, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
register("events_gram", lambda s, d: streaming_gram(read(s, d, "events").select((F.col("value") / 500).alias("a"), (F.col("user_id") % 10 / 10).alias("b")), ["a", "b"]).select("i", "j", F.round("v", 6).alias("v")), " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, round(sum({a} * {b}), 6) AS v FROM (SELECT value / 500 AS a, (user_id % 10) / 10 AS b FROM events)" for i, a, j, b in ((0, "a", 0, "a"), (0, "a", 1, "b"), (1, "b", 1, "b"))))

# -- triangles ----------------------------------------------------------------------------------------------------

for side, uplo, trans, unit in product("LR", "LU", "NT", (False, True)):
    b = B85 if side == "L" else B58
    x = S.tri(S8.sql, uplo, unit, 8)
    x = S.t(x) if trans == "T" else x
    name = f"{side}{uplo}{'_t' if trans == 'T' else ''}{'_unit' if unit else ''}".lower()
    matrix(f"trmm_{name}", lambda s, d, o=(side, uplo, trans, "U" if unit else "N"), b=b: triangular.trmm(*o, S8(s, d), b(s, d), 1.5), S.scale(1.5, S.mm(x, b.sql) if side == "L" else S.mm(b.sql, x)))
    matrix(f"trsm_{name}", lambda s, d, o=(side, uplo, trans, "U" if unit else "N"), b=b: triangular.trsm(*o, S8(s, d), b(s, d), 1.5), S.scale(1.5, S.solve(side, uplo, trans == "T", unit, S8.sql, b.sql, 8, 5)))
    if not unit:
        matrix(f"rectrxm_m_{name}", lambda s, d, o=(side, uplo, trans), b=b: triangular.rectrxm(*o, 0.5, "M", S8(s, d), b(s, d), 3), S.scale(0.5, S.mm(x, b.sql) if side == "L" else S.mm(b.sql, x)))
        matrix(f"rectrxm_s_{name}", lambda s, d, o=(side, uplo, trans), b=b: triangular.rectrxm(*o, 0.5, "S", S8(s, d), b(s, d), 4), S.scale(0.5, S.solve(side, uplo, trans == "T", False, S8.sql, b.sql, 8, 5)))
matrix("lauum_u", lambda s, d: triangular.lauum("U", S8(s, d)), f"(SELECT i, j, v FROM {S.mm(S.tri(S8.sql, 'U'), S.t(S.tri(S8.sql, 'U')))} WHERE j >= i UNION ALL SELECT i, j, v FROM {S8.sql} WHERE j < i)")
matrix("lauum_l", lambda s, d: triangular.lauum("L", S8(s, d)), f"(SELECT i, j, v FROM {S.mm(S.t(S.tri(S8.sql, 'L')), S.tri(S8.sql, 'L'))} WHERE j <= i UNION ALL SELECT i, j, v FROM {S8.sql} WHERE j > i)")

# -- LU -----------------------------------------------------------------------------------------------------------


def _packed(result: lu.LUResult) -> DataFrame:
    """L without its unit diagonal, and U, with the row and column that each place comes from."""
    both = Matrix(result.l.where(F.col("j") < F.col("i")).df.unionByName(result.u.df), result.l.m, result.u.n).compact()
    rows, columns = result.row_perm.toDF("i", "row"), result.col_perm.toDF("j", "col")
    return both.join(rows, "i").join(columns, "j").select("i", "j", "v", "row", "col")


def _packed_sql(a: str, n: int, pivot: str, last: bool = False) -> str:
    return f"SELECT x.i::INT AS i, y.j::INT AS j, round(z.m[x.i + 1][y.j + 1], 6) AS v, z.p[x.i + 1]::INT AS row, z.q[y.j + 1]::INT AS col FROM {S.lu(a, n, pivot, last)} z, (SELECT unnest(range({n})) AS i) x, (SELECT unnest(range({n})) AS j) y WHERE round(z.m[x.i + 1][y.j + 1], 6) <> 0"


for name, pivot, a in (("lu_nopivot", "none", N8), ("lu_rownonzero", "row_nonzero", P8), ("lu_rowmax", "row_max", P8), ("lu_complete", "complete", P8)):
    register(name, lambda s, d, pivot=pivot, a=a: _packed(lu.lu(a(s, d), pivot)), _packed_sql(a.sql, 8, pivot))
register("getc2", lambda s, d: _packed(lu.getc2(P8(s, d))), _packed_sql(P8.sql, 8, "complete", True))
register("lu_panels", lambda s, d: _packed(lu.lu_by_panels(P8(s, d), "row_max", 3)), _packed_sql(P8.sql, 8, "row_max"))
matrix("laswp", lambda s, d: lu.laswp(P8(s, d), [3, 5, 2, 7]), f"(SELECT k.k AS i, a.j, a.v FROM {P8.sql} a JOIN (VALUES (0, 3), (1, 5), (2, 2), (3, 7), (4, 4), (5, 1), (6, 6), (7, 0)) k(k, src) ON k.src = a.i)")
matrix("laswp_back", lambda s, d: lu.laswp(lu.laswp(P8(s, d), [3, 5, 2, 7]), [3, 5, 2, 7], forward=False), P8.sql)
register("det", lambda s, d: lu.lu(N8(s, d)).det().select(F.round("v", 6).alias("v")), f"SELECT round(list_product(list_transform(range(1, 9), lambda w: m[w][w])), 6) AS v FROM {S.lu(N8.sql, 8)}")
matrix("solve", lambda s, d: lu.lu(P8(s, d), "row_max").solve(B85(s, d)), S.solve("L", "U", False, False, S.packed(N8.sql, 8), S.solve("L", "L", False, True, S.packed(N8.sql, 8), S.flip(B85.sql, 8, True, False), 8, 5), 8, 5))

# -- reflectors ---------------------------------------------------------------------------------------------------


def _larfg(spark: SparkSession, d: str) -> DataFrame:
    row, v = reflectors.larfg(x8(spark, d))
    parts = v.compact().select(F.concat(F.lit("v"), "i").alias("what"), "v")
    two = row.select(F.explode(F.array(F.struct(F.lit("beta").alias("what"), rounded(F.col("beta")).alias("v")), F.struct(F.lit("tau").alias("what"), rounded(F.col("tau_re")).alias("v")))).alias("x")).select("x.*")
    return parts.unionByName(two)


_l = f"(SELECT a, CASE WHEN a >= 0 THEN -n ELSE n END AS beta FROM (SELECT (SELECT v FROM {x8.sql} WHERE i = 0) AS a, (SELECT sqrt(sum(v * v)) FROM {x8.sql}) AS n))"
register("larfg", _larfg, f"SELECT 'beta' AS what, round(beta, 6) AS v FROM {_l} UNION ALL SELECT 'tau', round((beta - a) / beta, 6) FROM {_l} UNION ALL SELECT 'v0', 1.0 UNION ALL SELECT 'v' || i, round(x.v / (a - beta), 6) FROM {x8.sql} x, {_l} WHERE i > 0")
h8 = S.add((1, S.eye(8)), (-0.6, S.mm(x8.sql, x8.T.sql)))
matrix("larf_l", lambda s, d: reflectors.larf("L", x8(s, d), 0.6, B85(s, d)), S.mm(h8, B85.sql))
matrix("larf_r", lambda s, d: reflectors.larf("R", x8(s, d), 0.6, B58(s, d)), S.mm(B58.sql, h8))
TAU = (0.5, 1.25, 0.75)
V83 = fold(30, 8, 0, 3)
U3 = S8.tri("U")
T3 = Input(lambda s, d: S8(s, d).slice((0, 3), (0, 3)), S.part(S8.sql, 0, 3, 0, 3))


def unit_sql(direct: str) -> str:
    """Columnwise V with its unit diagonal, 8 x 3."""
    off = 0 if direct == "F" else 5
    side = "i > j" if direct == "F" else "i - 5 < j"
    return f"(SELECT i, j, v FROM {V83.sql} WHERE {side} UNION ALL SELECT r + {off}, r, 1.0 FROM (SELECT unnest(range(3)) AS r))"


for direct, storev in product("FB", "CR"):
    w = unit_sql(direct)
    gram = S.mm(S.t(w), w)
    # T's inverse: V's inner products on the triangle's side, 1 / tau on the diagonal.
    inverse = f"(SELECT i, j, v FROM {gram} WHERE {'i < j' if direct == 'F' else 'i > j'} UNION ALL SELECT * FROM (VALUES {', '.join(f'({k}, {k}, (1.0 / {x})::DOUBLE)' for k, x in enumerate(TAU))}) q(i, j, v))"
    sql = S.solve("L", "U" if direct == "F" else "L", False, False, inverse, S.eye(3), 3, 3)
    stored = V83 if storev == "C" else V83.T
    matrix(f"larft_{direct}{storev}".lower(), lambda s, d, o=(direct, storev), v=stored: reflectors.larft(*o, v(s, d), np.array(TAU)), sql)
for side, trans in product("LR", "NC"):
    w, tt = unit_sql("F"), S.tri(T3.sql, "U")
    tt = S.t(tt) if trans == "C" else tt
    q = S.add((1, S.eye(8)), (-1, S.mm(S.mm(w, tt), S.t(w))))
    b = B85 if side == "L" else B58
    matrix(f"larfb_{side}_{trans}".lower(), lambda s, d, o=(side, trans), b=b: reflectors.larfb(*o, "F", "C", V83(s, d), T3(s, d), b(s, d)), S.mm(q, b.sql) if side == "L" else S.mm(b.sql, q))

# -- QR -----------------------------------------------------------------------------------------------------------

A86 = fold(0, 40, 0, 8)
R86 = S.cholesky(S.mm(A86.T.sql, A86.sql), 8)


def turned(r: Matrix) -> Matrix:
    """R with a positive diagonal, as only that is unique: each row is multiplied by its diagonal's sign."""
    sign = r.df.where("i = j").select("i", F.signum("v").alias("_s"))
    return Matrix(r.df.join(sign, "i").select("i", "j", (F.col("v") * F.col("_s")).alias("v")), r.m, r.n)


matrix("geqr2_r", lambda s, d: turned(qr.geqr2(A86(s, d))[0].slice((0, 8), (0, 8)).tri("U")), R86)
matrix("geqrt_r", lambda s, d: turned(qr.geqrt(A86(s, d), 3).r), R86)
rows8, E8 = folded(8)
matrix("qr_r_emb8", lambda s, d: qr.tall_r(rows8(s, d), "a", 8), S.cholesky(S.mm(S.t(E8), E8), 8))
SCALED = ("l_quantity / 50", "l_extendedprice / 100000", "l_discount * 10", "l_tax * 10")
_line = "(" + " UNION ALL ".join(f"SELECT row_number() OVER () AS i, {j} AS j, {c} AS v FROM lineitem" for j, c in enumerate(SCALED)) + ")"
_line_gram = "(" + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, sum(({a}) * ({b})) AS v FROM lineitem" for i, a in enumerate(SCALED) for j, b in enumerate(SCALED)) + ")"
matrix("qr_r_lineitem", lambda s, d: qr.tall_r(read(s, d, "lineitem").select(F.array(*(F.expr(c) for c in SCALED)).alias("a")), "a", 4), S.cholesky(_line_gram, 4))
_thin = S.solve("R", "U", False, False, R86, A86.sql, 8, 40)
# Rows of Q are rows of A times the inverse of R, and R's inverse solves R X = I.
_inverse = S.solve("L", "U", False, False, S.cholesky(S.mm(S.t(E8), E8), 8), S.eye(8), 8, 8)
matrix("qr_q_thin", lambda s, d: qr.tall_q(rows8(s, d), "vec_id", "a", 8)[0], S.mm(E8, _inverse))
matrix("qr_q_orthogonality", lambda s, d: (lambda q: gemm.gemm("T", "N", 1, q, q))(qr.geqrt(A86(s, d), 3).q()), S.eye(8))
B405, B540 = fold(100, 40, 0, 5), fold(200, 5, 0, 40)
matrix("unmqr_l_c", lambda s, d: (lambda f: turned_rows(qr.unmqr("L", "C", f, B405(s, d)).slice((0, 8), (0, 5)), f.r))(qr.geqrt(A86(s, d), 3)), S.mm(S.t(_thin), B405.sql))
matrix("unmqr_r_n", lambda s, d: (lambda f: turned_rows(qr.unmqr("R", "N", f, B540(s, d)).slice((0, 5), (0, 8)).T, f.r).T)(qr.geqrt(A86(s, d), 3)), S.mm(B540.sql, _thin))
matrix("unmqr_roundtrip_l", lambda s, d: (lambda f: qr.unmqr("L", "N", f, qr.unmqr("L", "C", f, B405(s, d))))(qr.geqrt(A86(s, d), 3)), B405.sql)
matrix("unmqr_roundtrip_r", lambda s, d: (lambda f: qr.unmqr("R", "C", f, qr.unmqr("R", "N", f, B540(s, d))))(qr.geqrt(A86(s, d), 3)), B540.sql)


def turned_rows(a: Matrix, r: Matrix) -> Matrix:
    sign = r.df.where("i = j").select("i", F.signum("v").alias("_s"))
    return Matrix(a.df.join(sign, "i").select("i", "j", (F.col("v") * F.col("_s")).alias("v")), a.m, a.n)


A1, A2 = S8.tri("U"), fold(60, 12, 0, 8)
A2U = Input(lambda s, d: fold(60, 8, 0, 8)(s, d).tri("U"), S.tri(fold(60, 8, 0, 8).sql, "U"))
_stack = lambda a, b: S.cholesky(S.add((1, S.mm(S.t(a), a)), (1, S.mm(S.t(b), b))), 8)
matrix("tsqrt_merge", lambda s, d: turned(qr.tsqrt(A1(s, d), A2(s, d), 3)[0].tri("U")), _stack(A1.sql, A2.sql))
matrix("ttqrt_merge", lambda s, d: turned(qr.ttqrt(A1(s, d), A2U(s, d), 3)[0].tri("U")), _stack(A1.sql, A2U.sql))


def _replay(factor, apply, right: bool, a1: Input, a2: Input) -> Build:
    """op(Q) and back: the first block of what comes out."""

    def build(s: SparkSession, d: str) -> Matrix:
        _, v, t = factor(A1(s, d), a2(s, d), 3)
        side = "R" if right else "L"
        x, y = apply(side, "C", a1(s, d), a2(s, d), v, t) if not right else apply(side, "N", a1(s, d), a2(s, d).T, v, t)
        return apply(side, "N" if not right else "C", x, y, v, t)[0]

    return build


matrix("tsmqr_l", _replay(qr.tsqrt, qr.tsmqr, False, S8, A2), S8.sql)
matrix("tsmqr_r", _replay(qr.tsqrt, qr.tsmqr, True, S8, A2), S8.sql)
matrix("ttmqr_l", _replay(qr.ttqrt, qr.ttmqr, False, S8, A2U), S8.sql)
matrix("ttmqr_r", _replay(qr.ttqrt, qr.ttmqr, True, S8, A2U), S8.sql)

# The same reflectors with V and T given: one panel, so the result has a closed form.
TV, TT = fold(140, 12, 0, 3), T3
for kind, name, side, trans in ((k, n, x, y) for (k, n) in ((qr.tsmqr, "tsmqr"), (qr.ttmqr, "ttmqr")) for x in "LR" for y in "NC"):
    cond = "true" if name == "tsmqr" else "i <= j"
    v = S.where(TV.sql, cond)
    tt = S.tri(TT.sql, "U")
    tt = S.t(tt) if trans == "C" else tt
    c1, c2 = (fold(160, 3, 0, 5), fold(170, 12, 0, 5)) if side == "L" else (fold(160, 5, 0, 3), fold(170, 5, 0, 12))
    w = S.mm(tt, S.add((1, c1.sql), (1, S.mm(S.t(v), c2.sql)))) if side == "L" else S.mm(S.add((1, c1.sql), (1, S.mm(c2.sql, v))), tt)
    second = S.add((1, c2.sql), (-1, S.mm(v, w) if side == "L" else S.mm(w, S.t(v))))
    matrix(f"{name}_{side}{trans}_given".lower(), lambda s, d, kind=kind, o=(side, trans), c1=c1, c2=c2: kind(*o, c1(s, d), c2(s, d), TV(s, d), TT(s, d).tri("U"))[1], second)

# -- pentagons ----------------------------------------------------------------------------------------------------

L_ = 2  # order of the triangular corner


def masked(v: str, direct: str, storev: str, rows: int, columns: int) -> str:
    upper = (storev == "C") == (direct == "F")
    return S.where(v, f"i - {rows - L_} <= j" if upper else f"j - {columns - L_} <= i")


for storev, trans in (("C", "T"), ("C", "C"), ("R", "N")):
    a = fold(220, 7, 0, 5) if storev == "C" else fold(220, 5, 0, 7)
    rows, columns = (7, 5) if storev == "C" else (5, 7)
    p = masked(a.sql, "F", storev, rows, columns)
    x, y = fold(230, 1, 0, 7).T, fold(231, 1, 0, 5).T
    matrix(f"pemv_{storev}{trans}".lower(), lambda s, d, o=(trans, storev), a=a, x=x, y=y: pentagon.pemv(*o, L_, 1.5, a(s, d), x(s, d), 0.5, y(s, d)), S.add((1.5, S.mm(S.t(p) if storev == "C" else p, x.sql)), (0.5, y.sql)))
for side, direct, storev in product("LR", "FB", "CR"):
    v = fold(240, 7, 0, 4) if storev == "C" else fold(240, 4, 0, 7)
    col = masked(v.sql, direct, storev, *((7, 4) if storev == "C" else (4, 7)))
    col = col if storev == "C" else S.t(col)
    left = side == "L"
    a1, a2 = (fold(260, 4, 0, 5), fold(270, 7, 0, 5)) if left else (fold(260, 5, 0, 4), fold(270, 5, 0, 7))
    w = fold(280, 4, 0, 5) if left else fold(280, 5, 0, 4)
    o = (side, direct, storev, L_)
    name = f"{side}{direct}{storev}".lower()
    w_sql = S.add((1, a1.sql), (1, S.mm(S.t(col), a2.sql) if left else S.mm(a2.sql, col)))
    matrix(f"pamm_w_{name}", lambda s, d, o=o, a1=a1, a2=a2, v=v: pentagon.pamm("W", *o, a1(s, d), a2(s, d), v(s, d)), w_sql)
    matrix(f"pamm_a_{name}", lambda s, d, o=o, a1=a1, a2=a2, v=v, w=w: pentagon.pamm("A", *o, a1(s, d), a2(s, d), v(s, d), w(s, d)), S.add((1, a2.sql), (-1, S.mm(col, w.sql) if left else S.mm(w.sql, S.t(col)))))
    for trans in "NC":
        t4 = Input(lambda s, d: S8(s, d).slice((0, 4), (0, 4)), S.part(S8.sql, 0, 4, 0, 4))
        tt = S.tri(t4.sql, "U" if direct == "F" else "L")
        tt = S.t(tt) if trans == "C" else tt
        w2 = S.mm(tt, w_sql) if left else S.mm(w_sql, tt)
        both = f"(SELECT i, j, v FROM {S.add((1, a1.sql), (-1, w2))} UNION ALL SELECT i + {4 if left else 0}, j + {0 if left else 4}, v FROM {S.add((1, a2.sql), (-1, S.mm(col, w2) if left else S.mm(w2, S.t(col))))})"

        def parfb(s, d, o=(side, trans, direct, storev, L_), a1=a1, a2=a2, v=v, t4=t4, left=left) -> Matrix:
            x, y = pentagon.parfb(*o, a1(s, d), a2(s, d), v(s, d), t4(s, d))
            m, n = (11, 5) if left else (5, 11)
            return Matrix(x.df.unionByName(y.shift(4 if left else 0, 0 if left else 4, m, n).df), m, n)

        matrix(f"parfb_{name}_{trans.lower()}", parfb, both)

# -- sources and sinks, and what an LU tells ------------------------------------------------------------------------


def _written(kind: str) -> Build:
    """The whole table, written in a form and read again."""

    def build(s: SparkSession, d: str) -> Matrix:
        from lattica.operators.block import BlockMatrix

        e, path = E(s, d), posixpath.join(shared_folder(s), f"matrix-{uuid.uuid4().hex}")
        if kind == "entries":
            parquet.write_entries(e, path)
            return parquet.read_entries(s, path, e.m, e.n)
        if kind == "rows":
            parquet.write_rows(e, path)
            return parquet.read_rows(s, path, "i", "a", e.n, e.m)
        parquet.write_blocks(BlockMatrix.from_matrix(e, 32), path)
        return parquet.read_blocks(s, path, e.m, e.n, 32).to_matrix()

    return build


for kind in ("entries", "rows", "blocks"):
    matrix(f"source_{kind}", _written(kind), E.sql)
# A matrix whose last column is twice its first has no pivot in the last step.
_lost = Input(lambda s, d: Matrix(S8(s, d).where(F.col("j") < 7).df.unionByName(S8(s, d).where(F.col("j") == 0).df.select("i", F.lit(7).cast("long").alias("j"), (2 * F.col("v")).alias("v"))), 8, 8), f"(SELECT i, j, v FROM {S8.sql} WHERE j < 7 UNION ALL SELECT i, 7, 2 * v FROM {S8.sql} WHERE j = 0)")


def _told(spark: SparkSession, d: str) -> DataFrame:
    """The step of the first pivot that is zero to rounding, as ``info`` and U's diagonal have it."""
    out = []
    for name, a in (("regular", S8(spark, d)), ("singular", _lost(spark, d))):
        f = lu.lu(a, "row_max")
        small = f.u.df.where("i = j").where(F.abs("v") >= 1e-9).agg(F.count("*").alias("n")).first()["n"]
        out.append((name, 0 if small == 8 else small + 1, bool(f.info == 0 or small < 8)))
    return spark.createDataFrame(out, "what string, step long, info_agrees boolean")


_steps = lambda a: f"(SELECT CASE WHEN count(*) = 8 THEN 0 ELSE count(*) + 1 END FROM {S.packed(a, 8, 'row_max')} WHERE i = j AND abs(v) >= 1e-9)"
register("lu_info", _told, f"SELECT 'regular' AS what, {_steps(S8.sql)}::BIGINT AS step, true AS info_agrees UNION ALL SELECT 'singular', {_steps(_lost.sql)}, true")

# -- whole tables by the ways for sizes beyond one task -----------------------------------------------------------

for u in "UL":
    cond = "j >= i" if u == "U" else "j <= i"
    matrix(f"syrk_blocks_{u.lower()}", lambda s, d, u=u: gemm.syrk(u, "T", 1.5, E(s, d), 0.5, S64(s, d), ib=16), ORACLES[f"syrk_{u.lower()}"].join(("(", ")")))
    x = S.tri(S64.sql, u)
    z = S.mm(x, S.t(x)) if u == "U" else S.mm(S.t(x), x)
    matrix(f"lauum_blocks_{u.lower()}", lambda s, d, u=u: triangular.lauum(u, S64(s, d), ib=16), f"(SELECT i, j, v FROM {z} WHERE {cond} UNION ALL SELECT i, j, v FROM {S64.sql} WHERE NOT {cond})")
R64 = S.cholesky(S.mm(E.T.sql, E.sql), 64)
matrix("qr_panels_r", lambda s, d: turned(qr.geqrt_by_panels(E(s, d), 24).r), R64)
matrix("unmqr_panels", lambda s, d: (lambda f: turned_rows(qr.unmqr("L", "C", f, E(s, d).slice((0, f.packed.m), (0, 64))).slice((0, 64), (0, 64)), f.r))(qr.geqrt_by_panels(E(s, d), 24)), R64)
register("lu_panels_gram", lambda s, d: lu.lu_by_panels(S64(s, d), "row_max", 24).u.compact(), S.result(S.where(S.packed(S64.sql, 64, "row_max"), "i <= j")))

# -- complex operands ---------------------------------------------------------------------------------------------


def cfold(r0: int, nr: int, nc: int, diagonal: float = 0) -> tuple[Build, tuple[str, str]]:
    re, im = fold(r0, nr, 0, nc), fold(r0, nr, 32, nc)
    re = re + eye(nr).scaled(diagonal) if diagonal else re
    return complexed(re, im), (re.sql, im.sql)


def ctri(a: tuple[str, str], uplo: str) -> tuple[str, str]:
    return S.tri(a[0], uplo), S.tri(a[1], uplo)


def csolve(a: tuple[str, str], b: tuple[str, str], n: int, other: int) -> tuple[str, str]:
    """X with A X = B, by the real system of twice the order."""
    whole = f"(SELECT i, j, v FROM {a[0]} UNION ALL SELECT i, j + {n}, -v FROM {a[1]} UNION ALL SELECT i + {n}, j, v FROM {a[1]} UNION ALL SELECT i + {n}, j + {n}, v FROM {a[0]})"
    right = f"(SELECT i, j, v FROM {b[0]} UNION ALL SELECT i + {n}, j, v FROM {b[1]})"
    factors = S.packed(whole, 2 * n)
    x = S.solve("L", "U", False, False, factors, S.solve("L", "L", False, True, factors, right, 2 * n, other), 2 * n, other)
    return S.part(x, 0, n, 0, other), S.part(x, n, 2 * n, 0, other)


(c4, s4), (c43, s43), (c34, s34) = cfold(5, 4, 4, 2), cfold(6, 4, 3), cfold(7, 3, 4)
for side, uplo, trans in product("LR", "LU", "NC"):
    x = ctri(s4, uplo)
    x = cadj(x) if trans == "C" else x
    left = side == "L"
    b, sb_ = (c43, s43) if left else (c34, s34)
    name = f"{side}{uplo}{'_c' if trans == 'C' else ''}".lower()
    o = (side, uplo, trans, "N")
    complex_matrix(f"complex_trmm_{name}", lambda s, d, o=o, b=b: triangular.trmm(*o, c4(s, d), b(s, d), 1.5), *(S.scale(1.5, z) for z in (cmm(x, sb_) if left else cmm(sb_, x))))
    if left:
        solved = csolve(x, sb_, 4, 3)
    else:
        solved = tuple(S.t(z) for z in csolve((S.t(x[0]), S.t(x[1])), (S.t(sb_[0]), S.t(sb_[1])), 4, 3))
    complex_matrix(f"complex_trsm_{name}", lambda s, d, o=o, b=b: triangular.trsm(*o, c4(s, d), b(s, d)), *solved)
for u in "UL":
    x = ctri(s4, u)
    cond = "j >= i" if u == "U" else "j <= i"
    z = cmm(x, cadj(x)) if u == "U" else cmm(cadj(x), x)
    complex_matrix(f"complex_lauum_{u.lower()}", lambda s, d, u=u: triangular.lauum(u, c4(s, d)), *(f"(SELECT i, j, v FROM {p} WHERE {cond} UNION ALL SELECT i, j, v FROM {q} WHERE NOT {cond})" for p, q in zip(z, s4, strict=True)))


def _rebuilt(pivot: str) -> Build:
    """L U with rows and columns in the order of A again."""

    def build(s: SparkSession, d: str) -> Matrix:
        f = lu.getc2(c4(s, d)) if pivot == "getc2" else lu.lu(c4(s, d), pivot)
        swapped = lambda p: p.select(F.col("src").alias("k"), F.col("k").alias("src"))
        return gemm.multiply(f.l, f.u).permute(swapped(f.row_perm)).permute(swapped(f.col_perm), 1)

    return build


for pivot in ("none", "row_nonzero", "row_max", "complete", "getc2"):
    complex_matrix(f"complex_lu_{pivot}", _rebuilt(pivot), *s4)
complex_matrix("complex_solve", lambda s, d: lu.lu(c4(s, d), "row_max").solve(c43(s, d)), *csolve(s4, s43, 4, 3))
(c93, s93), (c94, s94) = cfold(8, 9, 3), cfold(9, 9, 4)
complex_matrix("complex_qr", lambda s, d: (lambda f: gemm.multiply(f.q(), f.r))(qr.geqrt(c93(s, d), 2)), *s93)
complex_matrix("complex_unmqr", lambda s, d: (lambda f: qr.unmqr("L", "N", f, qr.unmqr("L", "C", f, c94(s, d))))(qr.geqrt(c93(s, d), 2)), *s94)
complex_matrix("complex_gram_of_r", lambda s, d: (lambda r: gemm.gemm("C", "N", 1, r, r))(qr.geqrt(c93(s, d), 2).r), *cmm(cadj(s93), s93))


def _ctiles(factor: Callable, second: Build) -> Build:
    """Rᴴ R of a triangle over a tile."""

    def build(s: SparkSession, d: str) -> Matrix:
        r = factor(c4(s, d).tri("U"), second(s, d), 2)[0].tri("U")
        return gemm.gemm("C", "N", 1, r, r)

    return build


c4u = ctri(s4, "U")
second_u = lambda s, d: cfold(10, 4, 4)[0](s, d).tri("U")
for name, factor, second, sql in (("tsqrt", qr.tsqrt, c94, s94), ("ttqrt", qr.ttqrt, second_u, ctri(cfold(10, 4, 4)[1], "U"))):
    complex_matrix(f"complex_{name}", _ctiles(factor, second), *cadd(1, cmm(cadj(c4u), c4u), cmm(cadj(sql), sql)))
for side, trans in product("LR", "NC"):
    left = side == "L"
    tt = ctri(s4, "U")
    tt = cadj(tt) if trans == "C" else tt
    (v74, sv), (a45, s45), (a75, s75) = cfold(11, 7, 4), cfold(12, 4, 5) if left else cfold(12, 5, 4), cfold(13, 7, 5) if left else cfold(13, 5, 7)
    p = tuple(masked(z, "F", "C", 7, 4) for z in sv)
    w = cadd(1, s45, cmm(cadj(p), s75)) if left else cadd(1, s45, cmm(s75, p))
    o = (side, "F", "C", L_)
    if trans == "N":
        complex_matrix(f"complex_pamm_w_{side}".lower(), lambda s, d, o=o, a=a45, b=a75, v=v74: pentagon.pamm("W", *o, a(s, d), b(s, d), v(s, d)), *w)
    w2 = cmm(tt, w) if left else cmm(w, tt)
    change = cmm(p, w2) if left else cmm(w2, cadj(p))
    complex_matrix(f"complex_parfb_{side}{trans}".lower(), lambda s, d, o=(side, trans, "F", "C", L_), a=a45, b=a75, v=v74: pentagon.parfb(*o, a(s, d), b(s, d), v(s, d), c4(s, d))[1], *cadd(-1, change, s75))
