"""Payment-flow analytics on Spark: validation, ledger, windowed mule rules,
transfer graph, bounded cycle search, alerts and scenario scoring.

Every operator is ``DataFrame -> DataFrame`` built from Spark SQL expressions,
so Catalyst plans it and the same code serves batch and streaming input.
"""

__version__ = "0.1.0"
