"""All queries over the reference tables and their SQL."""

from __future__ import annotations

from . import changes, documents, logs

QUERIES: dict = {**changes.QUERIES, **documents.QUERIES, **logs.QUERIES}
SQL: dict[str, str] = {**changes.SQL, **documents.SQL, **logs.SQL}
