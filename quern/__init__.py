"""quern: a PySpark-native analytics engine.

Everything is a DataFrame plan: Catalyst and adaptive execution choose the
physical strategy, helpers only add the operators that Spark SQL lacks.
"""

__version__ = "0.1.0"
