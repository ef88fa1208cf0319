"""Evidence retrieval, reconciliation and corpus preparation on Spark."""

from importlib import import_module

__version__ = "0.2.0"
_PLACES = {
    "Answers": "tessera.plans.engine",
    "EmbeddingBackend": "tessera.plans.interfaces",
    "Engine": "tessera.plans.engine",
    "ExtractiveSynthesizer": "tessera.plans.engine",
    "LatentBackend": "tessera.operators.index",
    "Registry": "tessera.operators.monitoring",
    "Synthesizer": "tessera.plans.interfaces",
    "load_corpus": "tessera.sources.corpus",
    "typed_documents": "tessera.sources.corpus",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    """Public names are imported when first used, so that workers load only what they run."""
    if name not in _PLACES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_PLACES[name]), name)
