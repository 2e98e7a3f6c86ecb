"""quire: paged-document processing on Spark DataFrames.

A quire is a gathering of leaves.  The package turns page specifications,
outlines and bookmark positions into rows and intervals, names and orders
pages, resolves lookup tables, and runs per-page pipelines - all as plain
DataFrame / SQL plans.
"""
