"""Named queries with the SQL that must give the same rows."""

QUERIES = {}
ORACLE = {}


def query(sql: str = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add
