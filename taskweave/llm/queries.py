"""Imports every module of this subpackage that registers queries."""

from taskweave.llm import (  # noqa: F401
    bytepairs,
    chat,
    divergence,
    linededup,
    orderminhash,
    packing,
    pii,
    prefixtrie,
    quality,
    sentencepieces,
    substrings,
    suffixes,
    vectors,
)
from taskweave.llm.registry import QUERIES, SQL  # noqa: F401
