"""Every query of this subpackage."""

from tapeloom.llm import (  # noqa: F401
    bpe, collocations, credentials, decontaminate, exact_copies, importance, jaccard, licences, personal, quality, sharding,
    token_files, topk)
from tapeloom.llm.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
