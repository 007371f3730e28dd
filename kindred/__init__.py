"""Near-duplicate image grouping as Spark DataFrame operators.

The work is: list files, compare with the stored snapshot, fingerprint what
changed, join fingerprints by Hamming distance, and label the connected
components.  See README.md for a tour.
"""

import sys

from pyspark import cloudpickle

# Functions handed to mapInPandas travel by value, so executors do not need
# this package on their own import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
