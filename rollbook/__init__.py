"""Record-register analytics on Spark DataFrames."""

from pyspark import cloudpickle

from rollbook.functions import text
from rollbook.operators import packing

# Ship the functions that run in Python workers with the job itself, so the
# package need not be installed on executors.
cloudpickle.register_pickle_by_value(text)
cloudpickle.register_pickle_by_value(packing)
