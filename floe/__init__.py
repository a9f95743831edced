"""floe: Spark-native preparation, distillation and evaluation of flow classifiers.

Every operator is a ``DataFrame -> DataFrame`` function (usable with
``df.transform``) or an estimator with ``fit(df) -> model`` and
``model.transform(df)``.  The work runs as Spark jobs: built-in column
expressions, aggregations, joins and shuffles; no row data is collected
to the driver, only bounded statistics (one value per feature or per
class) and column names.
"""

__version__ = "0.1.0"
