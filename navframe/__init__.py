"""navframe: NAV time-series analytics expressed as Spark DataFrame plans.

Every operator is a function from DataFrames (plus plain parameters) to a
DataFrame built from Catalyst expressions, so the work is planned, optimised
and executed by Spark. Sub-packages:

* ``functions``  - column expressions (percentage change, CAGR, Sharpe, dates)
* ``operators``  - windowed features, metrics, joins, deltas, portfolio work
* ``sources``    - readers for landed JSON / CSV / Parquet / JDBC and the
                   stand-in series derived from the test tables
* ``sinks``      - schema-checked append / overwrite / keyed-append writers
* ``plans``      - the composite jobs and the query catalogue
* ``streaming``  - incremental ingest of landed NAV documents
"""

from navframe.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
__version__ = "0.1.0"
