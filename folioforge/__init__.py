"""Form and document jobs on Spark: flat tables of blocks, cells, tokens and fields keyed by document."""
