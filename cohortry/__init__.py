"""cohortry: Spark-native cohort, image-table and gene-set analytics."""
