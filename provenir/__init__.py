"""provenir: a PySpark-native engine for code-provenance analytics.

Everything relational is a DataFrame plan left to Catalyst; Python runs only
where source text has to be parsed or scored, and then in Arrow batches.
"""

__version__ = "0.1.0"
