"""DataFrame operators for silhouette geometry and regression-evaluation analytics on Spark."""
