"""factloom: evidence-aware analytics and corpus preparation as Spark jobs."""
