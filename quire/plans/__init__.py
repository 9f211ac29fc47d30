"""Plans of several operators: ingestion, answers, evaluation."""
