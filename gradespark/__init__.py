"""Evaluation analytics for code-generation runs, written as Spark jobs.

Every public function takes and returns DataFrames or Columns, so it composes
with whatever the caller already does in Spark.
"""

import sys

from pyspark import cloudpickle

# Arrow UDF bodies travel to the workers by value: executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
