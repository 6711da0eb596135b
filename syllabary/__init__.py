"""Catalogue analytics on PySpark: query, load, derive and check course-catalogue style data."""

from syllabary.catalog import CATALOG, Catalog, Relation
from syllabary.session import configure, local_session
from syllabary.store import Store

__all__ = ["CATALOG", "Catalog", "Relation", "Store", "configure", "local_session"]
