"""assay: declarative data validation and normalization, compiled to Spark columns."""
