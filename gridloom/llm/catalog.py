"""Imports the modules that register the corpus queries, and registers the pipeline."""

from gridloom.plans import registry


def load() -> None:
    from gridloom.llm import bestfit, codes, hmm, mixing, near, packing, private, quality, repair, repetition, secrets, topk, urls  # noqa: F401

    if "pipeline" not in registry.QUERIES:
        import corpus_pipeline
        registry.query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
