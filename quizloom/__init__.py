"""Multiple-choice question data on Spark: parsing, prompts, tokens, splits, scoring, metrics, runs."""
