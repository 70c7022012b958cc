"""DataFrame in, DataFrame out operators of the recommendation pipeline."""
