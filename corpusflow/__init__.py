"""corpusflow: prepare, analyse and classify labelled text corpora on Spark.

Sub-packages
------------
``functions``  column expressions (text cleaning, arrays, tokens)
``operators``  ``DataFrame -> DataFrame`` steps
``sources``    readers, writers, vocabulary and model storage
``plans``      end-to-end jobs composed from the operators
``catalog``    the registered queries with their SQL twins
"""

import sys

from pyspark import cloudpickle

# Batch functions travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
