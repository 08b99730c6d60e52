"""vertebra: posture-telemetry analytics expressed as Spark DataFrame plans.

Every public operator takes and returns DataFrames (or Columns); Catalyst
plans the work, and Python runs only inside Arrow-batched pose inference.
"""

__version__ = "0.1.0"
