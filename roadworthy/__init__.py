"""roadworthy: vehicle-inspection reliability analytics as Spark DataFrame jobs.

Every public operator outside ``llm`` is a function ``DataFrame -> DataFrame`` built from
built-in ``pyspark.sql.functions``; Catalyst plans the work, AQE re-plans
shuffles at runtime.  Layout:

* ``sources``    - table registry, bindings of the test tables, ingest checks, sinks
* ``functions``  - column expressions (normalisation, classification, formatting)
* ``operators``  - fact build, segment statistics, rankings, defects, fuel,
                   exploration (filtered re-aggregation) and plate lookup
* ``plans``      - whole-pipeline composition and the registered query catalog
* ``llm``        - operators for preparing training data (optional, see README)
"""

from roadworthy.params import Thresholds

__all__ = ["Thresholds"]
