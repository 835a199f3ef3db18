"""peergraph: company-peer and company-relation research on annual-report text, Spark-first."""
