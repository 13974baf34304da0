"""Near-duplicate detection for media tables and training-data operators on Spark DataFrames."""

__version__ = "0.2.0"

#: What the package offers at its top, and where it is; read on demand, so that workers import only what they run.
_HOMES = {
    "ImageFinder": "twinsift.api", "VideoFinder": "twinsift.api", "ImageHasher": "twinsift.hashers", "VideoHasher": "twinsift.hashers",
    "IMAGE_EXTENSIONS": "twinsift.constants", "VIDEO_EXTENSIONS": "twinsift.constants", "EXCLUDED_FOLDERS": "twinsift.constants",
    "IMAGE_ROW": "twinsift.schema", "VIDEO_ROW": "twinsift.schema",
}
__all__ = ["__version__", *_HOMES]


def __getattr__(name: str):
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    from importlib import import_module

    return getattr(import_module(_HOMES[name]), name)
