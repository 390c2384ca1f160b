"""The corpus pipeline: STAGES in order, run() over the documents of a folder, and ORACLE_SQL. See quillon/llm/stages.py."""

from quillon.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
