"""All registered queries: ``name -> (query, DuckDB statement or None)``."""

from __future__ import annotations

from veilframe.plans import detection, masking, records, streams

CATALOG = {
    **detection.QUERIES,
    **masking.QUERIES,
    **records.QUERIES,
    **streams.QUERIES,
}
