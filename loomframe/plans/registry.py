"""Registered queries and their SQL twins: QUERIES maps a name to f(spark, sf_dir) -> DataFrame, SQL to DuckDB's words."""

QUERIES = {}
SQL = {}


def query(name, sql=None):
    """Register the function under ``name``, with its SQL twin where there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.strip()
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


from . import queries_clean, queries_data, queries_ml, queries_profile  # noqa: E402, F401
