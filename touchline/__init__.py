"""touchline: football event analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame`` and is
built from Spark's own functions, windows, joins and file sources. Work is
keyed by ``match_id`` and runs over all matches at once.
"""

from touchline.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
