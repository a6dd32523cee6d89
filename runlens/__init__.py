"""Analytics over benchmark runs of code-writing models, as Spark jobs."""
