"""quire: a Spark-first engine for opinion-article analytics.

Every operator takes and returns DataFrames; the core work is Spark SQL
expressions, joins, aggregations and windows.  Sub-packages:

* ``sources``   - readers and writers with explicit schemas, derived inputs
* ``functions`` - Column -> Column helpers (names, lists, HTML, patterns)
* ``operators`` - DataFrame -> DataFrame operators (ids, tags, authors, ...)
* ``plans``     - end-to-end jobs and the query registry
* ``streaming`` - incremental file intake on Structured Streaming
"""

from quire.session import ensure_checkpoint_dir, local_session, materialize

__all__ = ["ensure_checkpoint_dir", "local_session", "materialize"]
