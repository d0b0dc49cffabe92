"""The corpus pipeline: its stages, its run over documents, and its SQL (none; see ``quiresmith.llm.pipeline``)."""

from quiresmith.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
