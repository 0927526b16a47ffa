"""Operators of a training-data pipeline: fingerprints, packing, filters, de-duplication, extraction.

Nothing else in the library imports this package. Its functions travel to the executors by value, so
the executors need numpy, pandas and (for packing) tokenizers, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
