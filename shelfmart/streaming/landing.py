"""Marketplace pages as a file stream: each micro-batch is merged into the staging tables.

The stream's checkpoint remembers which files were read, which replaces a polling schedule; the scheduled run takes its
pages from the same file log. A batch replayed after a failure is merged again with the same staging tables; only its
set-aside rows are then logged twice.
"""

from __future__ import annotations

import datetime as dt

from shelfmart.plans.refresh import stage_new_files
from shelfmart.storage import TableStore


def ingest_available(
    store: TableStore, folder: str, run_at: dt.datetime, max_files: int | None = None, timeout: int | None = None
) -> tuple[int, int]:
    """Merge every page file not read before, then stop. Staged orders and set-aside rows are returned."""
    return stage_new_files(store, folder, run_at, max_files, timeout)
