"""docmap: Spark-native XML document -> typed warehouse table engine.

Every public function takes DataFrames (plus small configuration) and
returns a DataFrame, so a caller composes them into one Spark plan.
"""

__version__ = "0.1.0"
