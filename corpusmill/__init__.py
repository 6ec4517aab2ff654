"""corpusmill: curate labelled text corpora and score binary classifiers on Spark.

Every operator is a plain function from DataFrame to DataFrame or from Column to
Column; Catalyst plans the work.
"""
