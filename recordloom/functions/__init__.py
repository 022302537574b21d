from recordloom.functions.similarity import indel_similarity, lcs_length, within
from recordloom.functions.text import (
    escape_literal,
    file_stem,
    iri_encode,
    safe_double,
    strip,
    token_sort,
)
from recordloom.functions.vectors import binarize, clamp01, cosine, ngram_vector

__all__ = [
    "binarize",
    "clamp01",
    "cosine",
    "escape_literal",
    "file_stem",
    "indel_similarity",
    "iri_encode",
    "lcs_length",
    "ngram_vector",
    "safe_double",
    "strip",
    "token_sort",
    "within",
]
