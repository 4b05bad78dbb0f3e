"""stemma: corpus search, corpus statistics and relational text analytics on Spark."""
