"""Higher-order array functions that mark their lambda bodies.

Column functions in this package may be backed by session SQL functions
(one call, inlined by the analyzer).  Spark cannot resolve a SQL function
whose argument is a lambda variable, so while a lambda body is being built
the text functions fall back to their expanded expression form.  These
wrappers are ``pyspark.sql.functions`` higher-order functions plus that mark.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import functions as F

_state = threading.local()


def in_lambda() -> bool:
    return getattr(_state, "depth", 0) > 0


def _marked(f):
    @functools.wraps(f)  # keeps the signature: Spark reads the lambda's arity from it
    def body(*args):
        _state.depth = getattr(_state, "depth", 0) + 1
        try:
            return f(*args)
        finally:
            _state.depth -= 1
    return body


def transform(col, f):
    return F.transform(col, _marked(f))


def filter(col, f):  # noqa: A001 - mirrors pyspark.sql.functions.filter
    return F.filter(col, _marked(f))


def forall(col, f):
    return F.forall(col, _marked(f))


def exists(col, f):
    return F.exists(col, _marked(f))


def aggregate(col, initial, merge, finish=None):
    if finish is None:
        return F.aggregate(col, initial, _marked(merge))
    return F.aggregate(col, initial, _marked(merge), _marked(finish))
