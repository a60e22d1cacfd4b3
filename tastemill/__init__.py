"""tastemill: a Spark-native recommendation and analytics engine.

Every operator is a function from DataFrames to a DataFrame. Plans in
``tastemill.plans`` bind operators to the test tables and pair each one
with an equivalent DuckDB SQL text for checking.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with their code, so executors need
# neither this package on their path nor a particular working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from tastemill.session import get_spark, ensure_checkpoint_dir  # noqa: E402

__all__ = ["get_spark", "ensure_checkpoint_dir"]
