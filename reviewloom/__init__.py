"""Code-review analytics over tables and streams of submissions, as Spark jobs."""
