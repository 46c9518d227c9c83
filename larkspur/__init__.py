"""Larkspur: a PySpark-native engine for conversational-memory analytics.

Every operator takes DataFrames and returns DataFrames, for all users and all
queries at once; Catalyst picks the physical plan.  ``operators`` holds the
relational work, ``functions`` the Column builders, ``sources`` readers and
snapshot tables, ``plans`` the composed pipelines and the query registry,
``streaming`` the incremental forms.
"""
