"""panelstats: multi-rater panel analytics on Spark.

Every operator is a function from DataFrame(s) to a DataFrame; the plan is declared with
the DataFrame API and left to Catalyst/AQE.  Sub-packages:

- ``sources``   typed scans, writes, model persistence, schema profile
- ``functions`` column expressions (score repair, labels, sigmoid, text)
- ``operators`` table operators (profiles, joins, ranks, distributions, sampling,
                metrics, models, attribution, thematic table)
- ``plans``     the registered queries over the driver's tables and their SQL oracles
- ``streaming`` incremental ingest of assessment files
"""

from panelstats.session import get_session, shared_path, scratch

__all__ = ["get_session", "shared_path", "scratch"]
