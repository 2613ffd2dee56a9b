"""DataFrame in, DataFrame out: the relational and numeric operators."""
