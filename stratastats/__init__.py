"""DataFrame operators for regional statistics on Spark.

``functions``  column expressions (null-safe predicates, ids, ratios, buckets)
``operators``  DataFrame operators (profiling, roll-up, merge, ranks, strata)
``sources``    file readers with declared schemas, shared scratch tables
``plans``      multi-step pipelines built from the operators
``workload``   the registered queries over the supplied tables
"""

__version__ = "0.1.0"
