"""Operators for training-data pipelines over documents, vectors and pages.

Functions that run in tasks travel with the job, so executors need not have this package installed.
"""

from pyspark import cloudpickle as _cloudpickle

import opslens.llm as _package

_cloudpickle.register_pickle_by_value(_package)
