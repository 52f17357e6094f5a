"""almoneda: a Spark-native engine for public-procurement analytics.

Plans are declared with the DataFrame and SQL API; importing the package has no side effects.
"""

__version__ = "0.1.0"
