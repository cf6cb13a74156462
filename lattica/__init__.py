"""Dense linear algebra on DataFrames: matrices as entries, rows or blocks, planned by Spark."""

from lattica.matrix import Matrix
from lattica.operators.block import BlockMatrix
from lattica.operators.gemm import gemm, gemm_add, gemm_sub, her2k, herk, multiply, syr2k, syrk, tall_gram
from lattica.operators.lu import LUResult, getc2, laswp, lu, lu_by_panels
from lattica.operators.pentagon import pamm, parfb, pemv
from lattica.operators.qr import QRResult, geqr2, geqrt, tall_q, tall_r, tsmqr, tsqrt, ttmqr, ttqrt, unmqr
from lattica.operators.reflectors import larf, larfb, larfg, larft
from lattica.operators.triangular import lauum, rectrxm, trapezoid, trmm, trsm
from lattica.operators.vector import axpy, dot, gemv, gerc, geru
from lattica.types import ArgumentError, Diag, Direct, Pivot, Side, SingularError, StoreV, Trans, Uplo, ZeroPivotError, lamch

__all__ = [
    "ArgumentError", "BlockMatrix", "Diag", "Direct", "LUResult", "Matrix", "Pivot", "QRResult", "Side", "SingularError", "StoreV", "Trans", "Uplo", "ZeroPivotError",
    "axpy", "dot", "gemm", "gemm_add", "gemm_sub", "gemv", "geqr2", "geqrt", "gerc", "geru", "getc2", "her2k", "herk", "lamch", "larf", "larfb", "larfg", "larft", "laswp",
    "lauum", "lu", "lu_by_panels", "multiply", "pamm", "parfb", "pemv", "rectrxm", "syr2k", "syrk", "tall_gram", "tall_q", "tall_r", "trapezoid", "trmm", "trsm",
    "tsmqr", "tsqrt", "ttmqr", "ttqrt", "unmqr",
]
