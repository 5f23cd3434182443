"""Where the operators of this subpackage write what they read again; see ``veilspark.sources.storage``."""

from veilspark.sources.storage import publish, release, shared_folder, texts_in, written

__all__ = ["publish", "release", "shared_folder", "texts_in", "written"]
