"""All registered queries and their SQL."""

from siltstone.plans import code_queries, language_queries, report_queries, scan_queries, source_queries  # noqa: F401  they register themselves

FLAGSHIP = "q_scan_report"
QUERIES, ORACLES = source_queries.QUERIES, source_queries.ORACLES
