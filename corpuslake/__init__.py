"""Corpus, retrieval-evaluation and conversation-log analytics on Spark."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the query, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
