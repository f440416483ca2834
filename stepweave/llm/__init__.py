"""Operators for large training-data pipelines over text tables.

Nothing outside this folder imports it.  `registry` lists the queries that
`__spark_entry__.py` adds when the folder is there.
"""
