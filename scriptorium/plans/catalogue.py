"""Every query of the library by name, and its SQL."""

from . import corpus_queries, retrieval_queries, site_queries  # noqa: F401
from .common import ORACLE_SQL, QUERIES  # noqa: F401
