"""tessera: a Spark-native engine for typed knowledge graphs.

Nodes and edges live in DataFrames; retrieval, extraction, evaluation and the
data-quality operators are DataFrame plans.  Layering: ``functions`` and
``workspace`` know nothing of the rest, ``operators`` build on them, ``plans``
hold the registered queries.  The subpackage ``llm`` (text operators for
training data) imports from here; nothing here imports it.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions for Python workers travel with the plan, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
