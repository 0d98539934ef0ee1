"""Complete jobs: the operations pipeline, and the queries over the test tables."""
