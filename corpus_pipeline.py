"""A corpus from raw documents to packed sequences, stage by stage."""

from inkfold.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
