"""Places of public tokenizer files; every operator that needs one takes the path as a parameter."""

from __future__ import annotations


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
