"""Training-data operators: decontamination, joins, classifiers, token files, sharding.

Nothing outside this package imports it.  ``siltflow.llm.queries`` lists the queries
that ``__spark_entry__`` registers.
"""
