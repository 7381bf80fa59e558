"""Readers, writers and the guards around them."""

from ravelin.sources.files import (  # noqa: F401
    append_missing,
    md_table,
    probe_schema,
    read_json,
    read_ndjson,
    read_parquet,
    read_tsv,
    same_manifest,
    should_skip,
    with_row_index,
    write_json,
    write_parquet,
    write_tsv,
)
from ravelin.sources.store import Stale, clean, cut, get_json, mark, put_json, release, remove, shared_dir, there, write_made  # noqa: F401
from ravelin.sources.views import documents_log, events_log, orders_log, table  # noqa: F401
