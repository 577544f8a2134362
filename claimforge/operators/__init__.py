"""DataFrame operators: ``fn(df, col=..., ...) -> DataFrame``."""
