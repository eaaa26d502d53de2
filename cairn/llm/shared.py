"""The tables in the shared folder, under the name that the operators of this package use."""

from ..sources.stored_tables import batches, new_folder, remove, stored

__all__ = ["batches", "new_folder", "remove", "stored"]
