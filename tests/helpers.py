"""What test modules share besides fixtures."""

from datetime import datetime, timezone


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def naive(moment):
    """A collected timestamp (session zone UTC, but local in Python) as naive UTC."""
    return moment.astimezone(timezone.utc).replace(tzinfo=None)


def plan_of(frame):
    """The formatted physical plan."""
    utils = frame.sparkSession._jvm.org.apache.spark.sql.api.python.PythonSQLUtils
    return utils.explainString(frame._jdf.queryExecution(), "formatted")
