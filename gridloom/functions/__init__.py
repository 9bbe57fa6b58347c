"""Operator algebra: unary and binary operators, monoids and semirings as Spark columns."""
