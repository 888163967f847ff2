"""Places of the public vocabulary files. Operators take a path; these are the queries' defaults."""

from __future__ import annotations


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
