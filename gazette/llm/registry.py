"""The queries of this subpackage and the SQL they are compared with."""

QUERIES = {}
SQL = {}


def query(sql=None):
    """Register a ``(spark, sf_dir) -> DataFrame`` under its function name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
