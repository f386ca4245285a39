"""Every query of the library by name, with SQL for those that SQL can express."""

from __future__ import annotations

from quarrylens.plans import proxies, records, reports  # noqa: F401  records and reports add their queries to those of proxies

QUERIES: dict = dict(proxies.QUERIES)
SQL: dict[str, str] = dict(proxies.SQL)
FLAGSHIP = "duplicate_lines_by_source"
