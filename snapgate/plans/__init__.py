"""Dataset contracts, rule catalogue and the pipelines built from the operators."""
