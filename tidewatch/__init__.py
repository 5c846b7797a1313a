"""tidewatch: passive network-threat analytics expressed as PySpark DataFrame operators.

The package registers itself for by-value pickling, so that functions shipped to
executors need no installed copy of it there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
