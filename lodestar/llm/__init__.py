"""Training-data operators: dedup, decontamination, quality, language, PII, licences, mixing, token counts.

Task functions are pickled by value, so executors need only numpy, pyarrow and xxhash, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
