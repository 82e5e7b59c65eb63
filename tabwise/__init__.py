"""tabwise: a Spark-native tabular classification workbench.

Profiling, cleaning, delimited-list features, cached location enrichment,
ordinal encoding, imputation / robust scaling, deterministic stratified
splits and folds, nearest-neighbour resampling, tree learners, importance
based selection, cross-validated search, batch scoring and classification
metrics -- every operator takes and returns Spark DataFrames.
"""

__version__ = "0.1.0"
