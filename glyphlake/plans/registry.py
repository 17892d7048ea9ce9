"""Name -> query and name -> DuckDB SQL, gathered from the plan modules."""

from __future__ import annotations

from glyphlake.plans import documents, files, glyphs, sequences

QUERIES: dict = {**documents.QUERIES, **sequences.QUERIES, **glyphs.QUERIES, **files.QUERIES}
ORACLE: dict = {**documents.ORACLE, **sequences.ORACLE, **glyphs.ORACLE, **files.ORACLE}
