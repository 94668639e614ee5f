"""arcweave: network analytics and corpus preparation as DataFrame programs on Spark."""
