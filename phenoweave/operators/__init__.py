"""DataFrame operators of the cohort pipeline."""
