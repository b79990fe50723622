"""tallyweave: check what lenders report against independent evidence, on Spark.

Every operator takes and returns DataFrames; nothing is computed until an
action runs, except where a docstring says a bounded statistic is read first.
"""

from tallyweave.config import FxPolicy, TapeColumns, Thresholds

__all__ = ["FxPolicy", "TapeColumns", "Thresholds"]
