"""ragtables: retrieval-augmented-generation data work as Spark DataFrame operators.

Layout:
  functions/  Column -> Column expressions (text, tokens, vectors, rendering)
  operators/  DataFrame -> DataFrame operators (chunking, retrieval, prompts, evaluation, timing, profiles)
  sources/    readers and writers (files, markup, tables, index, evaluation sets, logs)
  plans/      plan helpers (size-checked broadcast, ordinals, checkpoints)
  streaming/  incremental ingest with Structured Streaming
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers need no installed copy."""
    import sys

    try:
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: rely on --py-files instead
        pass


_ship_by_value()
