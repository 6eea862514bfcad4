"""Registers the corpus pipeline at the top of the repository."""

import corpus_pipeline

QUERIES = {"pipeline": corpus_pipeline.run}
ORACLES = {} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL}
