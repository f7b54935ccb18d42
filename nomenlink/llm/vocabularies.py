"""Public vocabularies, loaded once per partition; their folder is a parameter."""

from __future__ import annotations

import base64
import os
import re

import numpy as np

from .common import remembered

BYTE_BPE = "byte_bpe_50k"
PIECES = "piece_bpe_32k"


def default_folder() -> str:
    """Where the environment keeps its public tokenizer files."""
    import public_tokenizers

    return os.path.dirname(public_tokenizers.path(f"{BYTE_BPE}.json"))


def _file(name: str, folder: str | None) -> str:
    return os.path.join(folder or default_folder(), name)


@remembered
def byte_bpe(folder: str | None = None):
    """The reference tokenizer of the byte-level vocabulary."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_file(f"{BYTE_BPE}.json", folder))


@remembered
def byte_ranks(folder: str | None = None):
    """The same vocabulary as ranks, which encode several times faster."""
    import public_tokenizers
    import tiktoken

    with open(_file(f"{BYTE_BPE}.tiktoken", folder), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        BYTE_BPE, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


@remembered
def pieces(folder: str | None = None):
    """The piece vocabulary with byte fallback."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=_file(f"{PIECES}.model", folder))


# Characters whose classes are the same in every Unicode version that the two encoders
# may use: printable ASCII, tab and line ends, Latin-1 letters and signs, and Latin
# Extended-A.
_COMMON = re.compile(r"[\t\n\r\x20-\x7e\xa1-ſ]*")
_SPECIAL = "<|endoftext|>"


def encode_ids(texts: list[str], folder: str | None = None) -> list[np.ndarray]:
    """Ids of the byte-level tokenizer, without added special tokens.

    Texts of common Latin characters without a special token's string go through the
    rank form of the vocabulary, which gives the same ids; all others go through the
    tokenizer itself.
    """
    ranks = byte_ranks(folder)
    out: list[np.ndarray] = []
    for text in texts:
        if _COMMON.fullmatch(text) and _SPECIAL not in text:
            out.append(np.asarray(ranks.encode_ordinary(text), np.uint32))
        else:
            ids = byte_bpe(folder).encode(text, add_special_tokens=False).ids
            out.append(np.asarray(ids, np.uint32))
    return out
