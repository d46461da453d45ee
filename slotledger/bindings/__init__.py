"""How the given tables become series, covariates and feeds."""
