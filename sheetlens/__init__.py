"""sheetlens: a PySpark-native engine for auditing document quality at scale.

``operators`` holds DataFrame-to-DataFrame operators, ``functions`` pure Column
builders, ``sources`` readers and writers, ``plans`` whole reports and their SQL
oracles, ``streaming`` the Structured Streaming faces and stateful folds.
"""

try:  # ship code that runs on executors by value, so they need no copy of the package
    from pyspark import cloudpickle as _cloudpickle
    import sys as _sys

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError):  # an older PySpark: executors import the package instead
    pass
