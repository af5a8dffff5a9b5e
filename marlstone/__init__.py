"""A panel analytics engine on Spark: signals as expressions, fused plans, evaluation and portfolios."""
