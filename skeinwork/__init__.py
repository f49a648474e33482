"""Spark-first document-context analytics. The names below are imported when they are first used, so that Python workers load what they need only."""

from importlib import import_module

_PLACES = {"ChunkResult": ".results", "ConvertResult": ".results", "DocumentMetadata": ".results", "chunk": ".results", "convert": ".results", "Pack": ".plans.pack", "build": ".plans.pack", "pack_folder": ".plans.pack", "write": ".plans.pack", "converter": ".sources.files", "register": ".sources.files", "supported_extensions": ".sources.files"}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name in _PLACES:
        return getattr(import_module(_PLACES[name], __name__), name)
    raise AttributeError(name)
