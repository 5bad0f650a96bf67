"""Near-duplicate media analytics on Spark.

The names below are loaded when they are asked for.
"""

from importlib import import_module

_PLACES = {
    "search": "operators.search",
    "search_with_references": "operators.search",
    "hash_videos": "media.hashing",
    "hash_paths": "media.hashing",
    "CreationOptions": "media.hashing",
    "review_order": "operators.resolution",
    "plan": "operators.resolution",
    "MatchStore": "sources.match_store",
    "CacheStore": "sources.cache_store",
    "FrameSource": "sources.frames",
    "FfmpegFrames": "sources.frames",
    "Config": "config",
}
_VALUES = {
    "DEFAULT_SEARCH_TOLERANCE": ("functions.hashing", "LIBRARY_TOLERANCE"),
    "DEFAULT_HASH_DURATION": ("functions.parsing", "HASH_DURATION"),
    "DEFAULT_SKIP_FORWARD": ("functions.parsing", "SKIP_FORWARD"),
    "sampling_plan": ("functions.parsing", "sampling_plan"),
}

__all__ = [*_PLACES, *_VALUES]  # noqa: PLE0604


def __getattr__(name: str):
    place, attribute = _VALUES.get(name) or (_PLACES.get(name), name)
    if place is None:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{place}"), attribute)
