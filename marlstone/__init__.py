"""A PySpark-native engine for catalog search analytics.

operators/  DataFrame -> DataFrame relational and retrieval operators
functions/  Column -> Column scalar functions
sources/    readers and writers with explicit schemas
plans/      whole queries built from the above, and their SQL oracles
streaming/  Structured Streaming versions of the stateful operators
"""
