"""Survey-scale search of periodic dips in light curves, as Spark DataFrame operators."""

__version__ = "0.1.0"
