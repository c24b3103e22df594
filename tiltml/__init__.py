"""tiltml: Spark-native operators and batch jobs for imbalanced two-class tables.

Layout
------
- ``tiltml.functions``  column expressions (hash draws, casts, struct cells, row folds)
- ``tiltml.sources``    parquet / delimited readers, sinks, train+test loading, fixtures
- ``tiltml.operators``  DataFrame -> DataFrame operators (sampling, aggregates,
                        evaluation, feature transforms, models, cleaning composites)
- ``tiltml.plans``      end-to-end batch jobs and the query catalogue used by
                        ``__spark_entry__``
- ``tiltml.llm``        operators of a training-data pipeline (optional: nothing else imports it)
"""

from tiltml.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
