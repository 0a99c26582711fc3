"""All registered queries of the core and the SQL to hold them against."""

from __future__ import annotations

from tracebook.plans import editions, evidence, library, pages, provenance, records

QUERIES = editions.QUERIES | evidence.QUERIES | library.QUERIES | pages.QUERIES | provenance.QUERIES | records.QUERIES
ORACLE_SQL = editions.ORACLE_SQL | evidence.ORACLE_SQL | library.ORACLE_SQL | pages.ORACLE_SQL | provenance.ORACLE_SQL | records.ORACLE_SQL
FLAGSHIP = "quote_tier_ledger"
