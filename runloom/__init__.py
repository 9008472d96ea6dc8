"""DataFrame operators for production-run analytics and plan checking on Spark."""

__version__ = "0.1.0"
