"""Transaction-risk analytics as Spark jobs: profile, engineer, split, train, evaluate, explain, score."""

__version__ = "0.1.0"
