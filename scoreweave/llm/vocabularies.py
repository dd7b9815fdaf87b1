"""Where the public vocabulary files lie; operators take such a path as a parameter."""

from __future__ import annotations

import public_tokenizers


def word_bpe() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_bpe_pattern() -> str:
    return public_tokenizers.PATTERN
