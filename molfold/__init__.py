"""molfold: molecular analytics expressed as Spark DataFrames.

Line notation is folded into molecular graphs, descriptors and fingerprints
with Catalyst array expressions; searches, joins and summaries are ordinary
DataFrame plans.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to executors with the plan, so workers do
# not need the package installed.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
