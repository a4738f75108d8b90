"""Where the vocabulary files of public tokenizers are."""

from __future__ import annotations


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file on this machine; the package is installed on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)
