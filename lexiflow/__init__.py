"""lexiflow: lexicon- and rule-driven text rewriting as PySpark relations."""
