"""sessionlens: user-journey analytics on Spark DataFrames.

Every operator is a function from DataFrame(s) to DataFrame(s), built on
Spark SQL expressions, window functions, aggregates and MLlib.  Nothing is
collected to the driver except model parameters of bounded size (k-means
centroids, per-feature means and deviations, small vocabularies).
"""

from sessionlens.session import ensure_checkpoint_dir, local_session

__all__ = ["local_session", "ensure_checkpoint_dir"]
