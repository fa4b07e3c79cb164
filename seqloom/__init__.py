"""seqloom: Spark-native operators for preparing and analysing sequence-model data.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the heavy
lifting is done by Spark SQL expressions, windows, joins and aggregations.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    # Functions of this package that run inside tasks (Arrow kernels, pandas
    # helpers) are pickled by value, so executors need no installed copy.
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older pickler: ship the package with --py-files
        pass


_ship_by_value()
