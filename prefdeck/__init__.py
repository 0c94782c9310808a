"""Human-preference data analytics as lazy Spark DataFrame operators."""

from prefdeck.session import configure, materialize

__all__ = ["configure", "materialize"]
