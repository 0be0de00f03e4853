"""Collects the registered queries and the SQL each one is checked against."""

QUERIES = {}
SQL = {}


def query(sql=None, name=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under its function name."""

    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn

    return add
