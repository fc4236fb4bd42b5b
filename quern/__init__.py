"""quern: a PySpark engine for preparing, packing and scoring text corpora."""
