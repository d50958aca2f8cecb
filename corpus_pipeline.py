"""The corpus pipeline: ``STAGES`` of (name, function), ``run(spark, sf_dir)`` and ``ORACLE_SQL``; its body is in the subpackage."""

from foliant.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
