"""The Matrix type and distributed operators beyond what the queries cover: complex and single data, edge sizes, errors."""

import numpy as np
import pytest

from lattica.matrix import Matrix
from lattica.operators import gemm, lu, pentagon, qr, reflectors, triangular, vector
from lattica.operators.block import BlockMatrix
from lattica.plans.physical import Strategy, choose_product
from lattica.sources import parquet
from lattica.streaming.gram import streaming_gram
from lattica.types import ArgumentError, SingularError, ZeroPivotError

rng = np.random.default_rng(11)


def draw(*s, cx=False):
    return rng.normal(size=s) + (1j * rng.normal(size=s) if cx else 0)


@pytest.fixture
def of(spark):
    return lambda a: Matrix.from_numpy(spark, a)


@pytest.mark.parametrize("cx", [False, True])
def test_views(of, cx):
    a = draw(5, 4, cx=cx)
    m = of(a)
    assert m.size() == (5, 4) and m.size(1) == 4 and len(m) == 20
    assert m[3, 2] == a[3, 2] and m[3 + 2 * 5] == a[3, 2]
    assert np.allclose(m.H.to_numpy(), a.conj().T) and np.allclose(m.T.to_numpy(), a.T)
    assert np.allclose(m.slice((1, 4), (2, 4)).to_numpy(), a[1:4, 2:4]) and np.allclose(m.strided(2).to_numpy(), a[::2])
    assert np.allclose(m.tri("L", diag="U").to_numpy(), np.tril(a, -1) + np.eye(5, 4))
    assert np.allclose(m.scale(2j).to_numpy(), 2j * a) and not m.scale(0).to_numpy().any()
    assert np.allclose(m.with_element((0, 0), 9).to_numpy()[0, 0], 9)
    assert np.isclose(m.fro_norm().first()[0], np.linalg.norm(a)) and np.isclose(m.one_norm().first()[0], np.linalg.norm(a, 1)) and np.isclose(m.inf_norm().first()[0], np.linalg.norm(a, np.inf))
    with pytest.raises(IndexError):
        m[5, 0]
    with pytest.raises(ArgumentError):
        m.slice((0, 6), (0, 1))


def test_entries_are_checked(spark):
    for rows in ([(0, None, 1.0)], [(0, 0, None)], [(-1, 0, 1.0)], [(3, 0, 1.0)]):
        with pytest.raises(ArgumentError):
            Matrix.from_entries(spark.createDataFrame(rows, "i int, j int, v double"), 2, 2, check=True)
    empty = Matrix.from_entries(spark.createDataFrame([], "i int, j int, v double"))
    assert empty.size() == (0, 0) and empty.last_nonzero_row().first()[0] == 0 and empty.fro_norm().first()[0] == 0


def test_float_columns_are_widened(spark):
    df = spark.createDataFrame([(0, [1.5, 2.5])], "k long, a array<float>")
    m = Matrix.from_rows(df, "k", "a", 2)
    assert m.df.dtypes[2] == ("v", "double") and m.to_numpy().tolist() == [[1.5, 2.5]]
    df = spark.createDataFrame([(0, 1, 2.0), (1, 3, 4.0)], "k long, x int, y double")
    assert Matrix.from_columns(df, "k", ["x", "y"]).to_numpy().tolist() == [[1, 2], [3, 4]]


@pytest.mark.parametrize("alpha", [0, 1, 0.7])
@pytest.mark.parametrize("n", [0, 1, 100])
def test_axpy(of, alpha, n):
    x, y = draw(n, 1), draw(n, 1)
    assert np.allclose(vector.axpy(alpha, of(x), of(y)).to_numpy(), alpha * x + y)


@pytest.mark.parametrize("cx", [False, True])
@pytest.mark.parametrize(("ta", "tb"), [("N", "N"), ("T", "N"), ("N", "C"), ("C", "T")])
@pytest.mark.parametrize("strategy", list(Strategy))
def test_gemm(of, cx, ta, tb, strategy):
    turn = {"N": lambda x: x, "T": lambda x: x.T, "C": lambda x: x.conj().T}
    a, b = draw(7, 5, cx=cx), draw(5, 6, cx=cx)
    got = gemm.multiply(of(turn[ta](a)).op(ta), of(turn[tb](b)).op(tb), strategy)
    assert np.allclose(got.to_numpy(), turn[ta](turn[ta](a)) @ turn[tb](turn[tb](b)))


def test_blocks(of, spark, tmp_path):
    a, b = draw(50, 70), draw(70, 33, cx=True)
    x, y = BlockMatrix.from_matrix(of(a), 3), BlockMatrix.from_matrix(of(b), 3)
    assert np.allclose(x.multiply(y).to_matrix().to_numpy(), a @ b)  # more than FAN_IN products a block
    parquet.write_blocks(x, str(tmp_path / "blocks"))
    assert np.allclose(parquet.read_blocks(spark, str(tmp_path / "blocks"), 50, 70, 3).to_matrix().to_numpy(), a)
    some = parquet.read_blocks(spark, str(tmp_path / "blocks"), 50, 70, 3, rows=(2, 4)).to_matrix().to_numpy()
    assert np.allclose(some[6:12], a[6:12]) and not some[:6].any() and not some[12:].any()
    parquet.write_entries(of(a), str(tmp_path / "entries"))
    assert np.allclose(parquet.read_entries(spark, str(tmp_path / "entries")).to_numpy(), a)
    assert choose_product(512, 512, 512) is Strategy.BLOCK and choose_product(10**6, 64, 64) is Strategy.ENTRY


def test_gemm_quick_returns(of):
    a, c = draw(3, 3), draw(3, 3)
    assert np.allclose(gemm.gemm("N", "N", 0, of(a), of(a), 2, of(c)).to_numpy(), 2 * c)
    with pytest.raises(ArgumentError):
        gemm.multiply(of(draw(2, 3)), of(draw(2, 3)))


@pytest.mark.parametrize("cx", [False, True])
@pytest.mark.parametrize(("side", "uplo", "trans"), [("L", "L", "N"), ("L", "U", "C"), ("R", "L", "T"), ("R", "U", "N")])
def test_triangles(of, cx, side, uplo, trans):
    a, b = draw(9, 9, cx=cx) + 5 * np.eye(9), draw(9, 4, cx=cx) if side == "L" else draw(4, 9, cx=cx)
    t = np.tril(a) if uplo == "L" else np.triu(a)
    t = {"N": t, "T": t.T, "C": t.conj().T}[trans]
    assert np.allclose(triangular.trmm(side, uplo, trans, "N", of(a), of(b), 2).to_numpy(), 2 * (t @ b if side == "L" else b @ t))
    for limit in (2, 100):
        x = triangular.rectrxm(side, uplo, trans, 2, "S", of(a), of(b), limit).to_numpy()
        assert np.allclose(t @ x if side == "L" else x @ t, 2 * b)
        x = triangular.rectrxm(side, uplo, trans, 2, "M", of(a), of(b), limit).to_numpy()
        assert np.allclose(x, 2 * (t @ b if side == "L" else b @ t))


def test_triangle_errors(of):
    with pytest.raises(SingularError):
        triangular.trsm("L", "L", "N", "N", of(np.diag([1.0, 0])), of(np.eye(2)))
    with pytest.raises(ArgumentError):
        triangular.trsm("L", "L", "N", "N", of(draw(2, 3)), of(np.eye(2)))
    with pytest.raises(ArgumentError):
        triangular.rectrxm("L", "L", "N", 1, "Q", of(np.eye(2)), of(np.eye(2)))


@pytest.mark.parametrize("cx", [False, True])
@pytest.mark.parametrize("uplo", "UL")
def test_lauum(of, cx, uplo):
    a = draw(6, 6, cx=cx)
    got = triangular.lauum(uplo, of(a)).to_numpy()
    if uplo == "U":
        want = np.triu(np.triu(a) @ np.triu(a).conj().T) + np.tril(a, -1)
    else:
        want = np.tril(np.tril(a).conj().T @ np.tril(a)) + np.triu(a, 1)
    assert np.allclose(got, want)


@pytest.mark.parametrize("panel", [3, 4, 20])
@pytest.mark.parametrize(("m", "n"), [(10, 10), (13, 7), (7, 13)])
def test_lu_by_panels(of, panel, m, n):
    a = draw(m, n)
    f = lu.lu_by_panels(of(a), "row_max", panel)
    rows = np.zeros(m, int)
    for r in f.row_perm.collect():
        rows[r["k"]] = r["src"]
    assert np.allclose(f.l.to_numpy() @ f.u.to_numpy(), a[rows]) and f.info == 0
    assert np.abs(np.tril(f.l.to_numpy(), -1)).max() <= 1 + 1e-12


@pytest.mark.parametrize("cx", [False, True])
@pytest.mark.parametrize("pivot", ["row_max", "complete"])
def test_solve_and_det(of, cx, pivot):
    a, b = draw(6, 6, cx=cx), draw(6, 2, cx=cx)
    f = lu.lu(of(a), pivot)
    assert np.allclose(a @ f.solve(of(b)).to_numpy(), b)
    d = f.det().first()
    assert np.isclose(complex(*d), np.linalg.det(a))


def test_singular_lu(of):
    with pytest.raises(SingularError):
        lu.lu(of(np.array([[1.0, 2], [2, 4]])), check=True)
    assert lu.lu(of(np.array([[1.0, 2], [2, 4]]))).info == 2
    with pytest.raises(ZeroPivotError) as e:
        lu.lu(of(np.array([[0.0, 1], [1, 0]])), "none")
    assert e.value.step == 1
    assert lu.lu_by_panels(of(np.array([[1.0, 2, 0], [2, 4, 0], [1, 1, 1]])), "row_max", 1).info == 3


@pytest.mark.parametrize("cx", [False, True])
def test_reflectors(of, cx):
    x, c = draw(8, 1, cx=cx), draw(8, 3, cx=cx)
    row, v = reflectors.larfg(of(x))
    r = row.first()
    v = v.to_numpy()
    tau = complex(r["tau_re"], r["tau_im"]) if cx else r["tau_re"]
    h = np.eye(8) - tau * v @ v.conj().T
    assert np.allclose(h.conj().T @ x, np.r_[[[r["beta"]]], np.zeros((7, 1))])
    assert np.allclose(reflectors.larf("L", of(v), tau, of(c)).to_numpy(), h @ c)
    tau = draw(3, cx=cx)
    for direct in "FB":
        t = reflectors.larft(direct, "C", of(c), tau)
        from lattica.operators import kernels

        assert np.allclose(t.to_numpy(), kernels.larft(direct, "C", c, tau))
        b = draw(4, 8, cx=cx)
        got = reflectors.larfb("R", "C", direct, "C", of(c), t, of(b)).to_numpy()
        assert np.allclose(got, kernels.larfb("R", "C", direct, "C", c, t.to_numpy(), b))
    with pytest.raises(ArgumentError):
        reflectors.larf("L", of(draw(3, 1)), 1, of(c))


@pytest.mark.parametrize("cx", [False, True])
@pytest.mark.parametrize(("m", "n"), [(12, 5), (5, 12), (6, 6)])
def test_qr(of, cx, m, n):
    a = draw(m, n, cx=cx)
    f = qr.geqrt(of(a), 2)
    q = f.q(thin=False).to_numpy()
    assert np.allclose(q[:, : min(m, n)] @ f.r.to_numpy(), a) and np.allclose(q.conj().T @ q, np.eye(m))
    if cx:
        with pytest.raises(ArgumentError):
            qr.unmqr("L", "T", f, of(a))


def test_tall(spark):
    a = draw(500, 6)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(a)], "k long, a array<double>").repartition(7)
    q, r = qr.tall_q(df, "k", "a", 6)
    assert np.allclose(q.to_numpy() @ r.to_numpy(), a) and np.allclose(q.to_numpy().T @ q.to_numpy(), np.eye(6))
    assert np.allclose(qr.tall_r(df, "a", 6).to_numpy(), r.to_numpy())
    few = qr.tall_r(df.where("k < 3"), "a", 6).to_numpy()
    assert np.allclose(few.T @ few, a[:3].T @ a[:3])


def test_pemv_edges(of):
    a, x, y = draw(5, 4), draw(5, 1), draw(4, 1)
    assert not pentagon.pemv("T", "C", 2, 0, of(a), of(x), 0, of(y)).to_numpy().any()  # y is set, not left
    assert np.allclose(pentagon.pemv("T", "C", 0, 1, of(a), of(x), 0, of(y)).to_numpy(), a.T @ x)
    for bad in (("N", "C", 2), ("T", "R", 2), ("T", "C", 5)):
        with pytest.raises(ArgumentError):
            pentagon.pemv(*bad, 1, of(a), of(x), 0, of(y))
    with pytest.raises(ArgumentError):
        pentagon.pamm("Q", "L", "F", "C", 1, of(a), of(a), of(a))


@pytest.mark.parametrize("side", "LR")
def test_complex_parfb_is_unitary(of, side):
    v, a1, a2 = draw(7, 3, cx=True), draw(3, 4, cx=True), draw(7, 4, cx=True)
    p = pentagon.pentagon(of(v), 2, "F", "C").to_numpy()
    t = np.linalg.inv(np.triu(np.eye(3) + p.conj().T @ p, 1) + np.diag(np.diag(np.eye(3) + p.conj().T @ p).real / 2))
    if side == "R":
        a1, a2 = a1.T, a2.T
    x, y = pentagon.parfb(side, "C", "F", "C", 2, of(a1), of(a2), of(v), of(t))
    b1, b2 = pentagon.parfb(side, "N", "F", "C", 2, x, y, of(v), of(t))
    assert np.allclose(b1.to_numpy(), a1) and np.allclose(b2.to_numpy(), a2)
    with pytest.raises(ArgumentError):
        pentagon.parfb(side, "T", "F", "C", 2, of(a1), of(a2), of(v), of(t))


def test_streaming_gram(spark, tmp_path):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(40, 2))], "a double, b double")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("a double, b double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_gram(stream, ["a", "b"]).writeStream.outputMode("complete").format("memory").queryName("gram").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["i"], r["j"]): r["v"] for r in spark.table("gram").collect()}
    want = {(r["i"], r["j"]): r["v"] for r in streaming_gram(df, ["a", "b"]).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)


def test_filters_reach_the_scan(spark, data):
    from lattica.catalog import emb

    plan = emb(0, 8, 0, 4)(spark, data).df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(vec_id), GreaterThanOrEqual(vec_id,0), LessThan(vec_id,8)" in plan


# -- paths for sizes beyond one task ------------------------------------------------------------------------------


def rows_of(spark, a, parts=7):
    return spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(a)], "k long, a array<double>").repartition(parts)


@pytest.mark.parametrize("uplo", "UL")
@pytest.mark.parametrize("cx", [False, True])
def test_rank_k_by_blocks(of, cx, uplo):
    a, c = draw(11, 70, cx=cx), draw(11, 11, cx=cx)
    half = np.triu if uplo == "U" else np.tril
    assert np.allclose(gemm.syrk(uplo, "N", 2, of(a), 3, of(c), ib=2).to_numpy(), half(2 * a @ a.T + 3 * c))
    assert np.allclose(gemm.herk(uplo, "C", 2, of(a.T), 1, of(c), ib=3).to_numpy(), half(2 * a.conj() @ a.T + c))
    t = draw(9, 9, cx=cx)
    assert np.allclose(triangular.lauum(uplo, of(t), ib=2).to_numpy(), triangular.lauum(uplo, of(t)).to_numpy())


@pytest.mark.parametrize("cx", [False, True])
def test_block_products_in_squares(of, cx):
    a, b = draw(23, 41, cx=cx), draw(41, 17)
    got = BlockMatrix.from_matrix(of(a), 2).multiply(BlockMatrix.from_matrix(of(b), 2)).to_matrix()
    assert np.allclose(got.to_numpy(), a @ b)


@pytest.mark.parametrize("bad", [[1.0, 2.0], [1.0, None, 3.0], None, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]])
def test_ragged_cells_are_errors(spark, bad):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (1, bad), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "k long, a array<double>")
    for f in (lambda: gemm.tall_gram(df, "a", 3).df.collect(), lambda: qr.tall_r(df, "a", 3).df.collect(), lambda: qr.tall_q(df, "k", "a", 3)):
        with pytest.raises(Exception, match="has not 3 numbers"):
            f()


@pytest.mark.parametrize("kind", ["full", "deficient", "zero column", "wide"])
def test_tree_is_replayed(spark, monkeypatch, kind):
    monkeypatch.setattr(qr, "LEAF", 5)
    monkeypatch.setattr(qr, "FAN_IN", 3)
    a = draw(3 if kind == "wide" else 200, 4)
    if kind == "deficient":
        a[:, 3] = a[:, 0] - 2 * a[:, 1]
    if kind == "zero column":
        a[:, 1] = 0
    q, r = (x.to_numpy() for x in qr.tall_q(rows_of(spark, a), "k", "a", 4))
    assert np.allclose(q @ r[: q.shape[1]], a) and np.allclose(q.T @ q, np.eye(min(a.shape))) and (np.diagonal(r) >= -1e-12).all()
    got = qr.tall_r(rows_of(spark, a, 12), "a", 4).to_numpy()
    assert np.allclose(got.T @ got, a.T @ a)
    assert qr.tall_q(rows_of(spark, a).limit(0), "k", "a", 4)[0].size() == (0, 4)


@pytest.mark.parametrize(("m", "n"), [(40, 7), (7, 12), (9, 9)])
def test_qr_by_panels(of, m, n):
    a, c = draw(m, n), draw(m, 3)
    f = qr.geqrt_by_panels(of(a), 3)
    k = min(m, n)
    q = f.q(thin=False).to_numpy()
    assert np.allclose(q[:, :k] @ f.r.to_numpy(), a) and np.allclose(q.T @ q, np.eye(m))
    for trans, x in (("N", q), ("C", q.T)):
        assert np.allclose(qr.unmqr("L", trans, f, of(c)).to_numpy(), x @ c) and np.allclose(qr.unmqr("R", trans, f, of(c.T)).to_numpy(), c.T @ x)


def test_large_qr_goes_by_panels(spark, monkeypatch):
    monkeypatch.setattr(qr, "LOCAL_ELEMENTS", 100)
    a = draw(30, 5)
    f = qr.geqrt(Matrix.from_numpy(spark, a))
    assert f.panel and np.allclose(f.q().to_numpy() @ f.r.to_numpy(), a)


def test_tall_lu_has_narrow_panels(of, monkeypatch):
    monkeypatch.setattr(lu, "LOCAL_ELEMENTS", 400)
    a = draw(50, 6)
    f = lu.lu_by_panels(of(a), "row_max")
    rows = {r["k"]: r["src"] for r in f.row_perm.collect()}
    assert np.allclose(f.l.to_numpy() @ f.u.to_numpy(), a[[rows[k] for k in range(50)]])
