"""cohortspark: cohort-outcome analytics on Spark DataFrames.

Sub-packages
  functions  Column builders for cleaning and calendar arithmetic
  sources    CSV / mapping / table readers, writers and load manifests
  operators  DataFrame operators (joins, aggregates, ranks, labels, features,
             training matrices, metrics, resampling, models, exploration)
  plans      end-to-end jobs: cleaning per partner profile, integration, windows
"""

__version__ = "0.1.0"
