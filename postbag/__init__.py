"""Message-corpus analytics as composable Spark DataFrame transforms."""

import sys

from pyspark import cloudpickle

from postbag.operators.filters import Criteria
from postbag.plans.ask import AskOptions, ask, run_ask
from postbag.session import build_session

# The few functions that run in Python workers travel with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AskOptions", "Criteria", "ask", "build_session", "run_ask"]
