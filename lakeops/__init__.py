"""Data operators for a zoned clinical lakehouse, written as Spark DataFrame transformations.

Layout
    functions   column expressions
    sources     registry, readers and storage listing
    operators   DataFrame in, DataFrame out
    sinks       writers that are safe to run again
    plans       jobs that chain the operators
    checks      derivations of test inputs, registered queries and their SQL counterparts
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
