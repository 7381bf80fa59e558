"""ravelin: a PySpark-native analytics engine for user-item interaction logs.

Every operator is a function from DataFrames to DataFrames; nothing here runs
an action unless its docstring says so.
"""

__version__ = "0.1.0"
