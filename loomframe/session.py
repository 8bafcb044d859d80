"""One place for the session settings that the library relies on."""

from pyspark.sql import SparkSession


def build_session(app="loomframe", master=None, **conf):
    """A session with ANSI left on, UTC, adaptive execution, and the legacy charsets that CSV probing needs.

    On a cluster pass no master and let spark-submit decide; in tests pass ``local[8]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**defaults, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()
