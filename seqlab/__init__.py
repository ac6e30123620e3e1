"""seqlab: curation, description, evaluation and screening of labelled sequence tables on Spark."""
