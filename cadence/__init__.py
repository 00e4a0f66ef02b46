"""cadence — a PySpark-native behaviour-analytics engine.

Every operator is a function ``DataFrame -> DataFrame`` (or ``-> Column``)
built from Spark SQL / DataFrame expressions so Catalyst can push filters
and prune columns down to the scan and whole-stage codegen can fuse the
projections. Python workers run only where the user supplies Python code
(custom features, custom state logic, foreign models).

Sub-packages:

* ``sources``    — readers, bounded reads, sinks, upserts
* ``functions``  — scalar column functions and the feature-spec compiler
* ``operators``  — cleaning, runs, as-of targets, lookups, encodings,
                   profiling, text/language, synthesis, ML, behaviour
* ``streaming``  — Structured Streaming twins of the incremental operators
* ``plans``      — the registered query catalog (``queries``/``oracle_sql``)
"""

from cadence.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
