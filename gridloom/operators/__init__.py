"""Matrices, vectors and the operations on them."""
