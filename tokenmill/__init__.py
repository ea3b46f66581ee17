"""tokenmill: sequence-corpus analytics expressed as Spark DataFrame plans.

Sub-packages
------------
functions  Column-level expressions (text cleaning, id arrays, score math).
sources    Readers and writers (pairs, documents, vocab dumps, run logs, sinks).
operators  DataFrame-level operators (vocabularies, BPE, batching, scoring,
           BLEU, decoding over score tables, run analytics).
plans      Fixtures derived from the input tables and the registered queries.
streaming  Structured Streaming versions of text encoding and run monitoring.
"""

import sys as _sys

# Ship this package's functions and classes (mapInPandas bodies, pandas UDFs,
# stream state functions) to Python workers by value, so executors need no
# installed copy and no path setup.
try:  # pragma: no cover - depends on the pyspark build
    from pyspark import cloudpickle as _cp
    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass

__all__ = ["constants", "session"]
