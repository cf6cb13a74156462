"""The operators, by family: vectors and rank-1 updates, products, triangles, LU, reflectors, QR, pentagons."""
