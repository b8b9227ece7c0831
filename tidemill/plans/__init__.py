"""Physical-plan helpers: materialisation, quantiles, row order, hot keys, step sequences."""
