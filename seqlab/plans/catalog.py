"""Import every query module, so that the registry is complete."""

from importlib import import_module

MODULES = (
    "source_queries", "significance_queries", "curation_queries", "matching_queries", "descriptor_queries", "metric_queries", "screening_queries", "vector_queries", "similarity_queries", "model_queries",
)


def load() -> None:
    for name in MODULES:
        import_module(f"seqlab.plans.{name}")
