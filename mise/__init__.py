"""mise: recipe-page extraction, rendering and corpus QA as Spark jobs.

Pages go in as a DataFrame ``(page_id, url, html)``; out come a nested
``recipes`` table, a ``rejects`` table, rendered ``documents`` and QA
verdicts.  Every public function takes and returns a DataFrame or a Column.
"""

import sys as _sys

__version__ = "0.1.0"


def _pickle_udfs_by_value() -> None:
    """Python UDFs of this package are pickled with their code, so executors'
    Python workers need no installed copy of the package (no --py-files)."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(_sys.modules[__name__])


_pickle_udfs_by_value()
