"""All queries of the corpus operators and of the pipeline over them."""

import corpus_pipeline
from sessionloom.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
SQL = {**queries.SQL, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
