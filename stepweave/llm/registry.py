"""All queries of this folder, and the pipeline."""

import corpus_pipeline

from . import queries as _queries

QUERIES = {**_queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLE_SQL = dict(_queries.ORACLE_SQL)
