"""axisweave: labelled two-dimensional data as Spark relations.

A matrix is a DataFrame of non-zero cells ``(r, c, v)`` plus two axis
DataFrames ``(label, pos, deco)``; every operation is a DataFrame plan.
"""
