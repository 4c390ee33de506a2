"""Training-data operators: scoring, deduplication, tokenising, extraction, filtering and sharding.

Nothing else in the library imports this subpackage. Python code that runs in tasks is
sent with the plan, so executors need no copy of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
