"""newsloom: interest-profile news analytics as Spark jobs."""
