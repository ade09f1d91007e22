"""Feature x sample analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Task functions travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from assaygrid.model import Layer, Project, Result, make_layer  # noqa: E402

__all__ = ["Layer", "Project", "Result", "make_layer"]
