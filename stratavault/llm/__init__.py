"""Training-data operators: ten distributed operators over raw text, pages and vectors.

Nothing outside this package imports it.  Each module holds one operator with
its own general interface and the thin ``opN_*`` query that applies it with
production parameters to a whole table.
"""
