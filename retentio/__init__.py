"""retentio: customer churn and retention analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames (or fitted ``pyspark.ml`` models),
is parametrised by column names, and runs as Spark jobs: no row-level data is
collected to the driver.
"""

from retentio.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
