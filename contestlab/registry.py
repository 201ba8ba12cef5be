"""All registered queries and the SQL that checks them."""

from contestlab.plans import composite_studies, detail_figures, joins_aggregates, live_batches, models, pattern_studies, rule_tables, selection, side_figures, studies, tickets  # noqa: F401  (they register their queries)
from contestlab.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
