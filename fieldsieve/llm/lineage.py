"""Tables in the folder that all executors share, and free column names; as the rest of the package has them."""

from ..tables import clean, cut, own_folder, shared_folder, unused

__all__ = ["clean", "cut", "own_folder", "shared_folder", "unused"]
