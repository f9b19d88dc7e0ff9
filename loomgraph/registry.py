"""Every registered query: its DataFrame form and, where SQL can say it, its SQL twin."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    """Register a function (spark, sf_dir) -> DataFrame, and its DuckDB text."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def queries():
    from . import plans

    plans.load()
    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(ORACLES)
