"""retentia: player-retention analytics as Spark DataFrame operators.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the
work is expressed with built-in DataFrame / SQL functions so Catalyst
can prune, push down and fuse it.
"""

__version__ = "0.1.0"
