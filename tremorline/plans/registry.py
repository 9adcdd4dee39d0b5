"""All queries of the core by name, with their SQL where SQL can express them."""

from __future__ import annotations

from tremorline.plans import associate, linking, linking_sql, problems, problems_sql, relational, relational_sql, waveform_queries

FLAGSHIP = "o54_associate"
QUERIES = {**relational.QUERIES, **associate.QUERIES, **linking.QUERIES, **waveform_queries.QUERIES, **problems.QUERIES}
ORACLES = {**relational_sql.ORACLES, **problems_sql.ORACLES, **linking_sql.ORACLES}
