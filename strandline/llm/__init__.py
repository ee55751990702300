"""Training-data operators: one module per operator, each with a DataFrame-in, DataFrame-out
interface.  Nothing outside this subpackage imports it; the queries built on it are in
``registry``.
"""
