"""helixframe: Spark-native analytics for depth, genotype, lineage, ancestry and cohort workloads."""

__version__ = "0.1.0"
