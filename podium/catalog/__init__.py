"""The registered queries, each with the SQL that must give the same rows."""

from podium.catalog import evaluation, lexical, preparation, storage, vectors  # noqa: F401
from podium.catalog.registry import ORACLES, QUERIES  # noqa: F401
