"""clearfold: labelled corpora, typed text features and honest evaluation as Spark jobs."""

__version__ = "0.1.0"
