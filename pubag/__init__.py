"""pubag: positive/unlabelled bagging and label-reliability jobs on Spark.

Everything is expressed with DataFrames: rows are identified by a key
column, every random choice is a hash of (seed, purpose, ids), and the
ensemble of T bags is trained, scored and evaluated as one Spark job with
``bag`` as an ordinary column.
"""

from pubag.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
