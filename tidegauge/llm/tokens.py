"""Byte-level BPE ids inside Arrow tasks."""

from __future__ import annotations

import functools
import json

import numpy as np


@functools.lru_cache(maxsize=4)
def encoder(path: str, added: bool = False):
    """text -> numpy uint32 ids of a byte-level BPE tokenizer file (tokenizers' JSON).

    The ids are those of the tokenizers library with add_special_tokens=False;
    the merges run in tiktoken, which is about five times as fast. In a
    byte-level BPE vocabulary the id of a token is its merge rank, so the
    vocabulary is all that is needed. With added, the strings of added tokens in
    a text become their ids, as in a Tokenizer as loaded; without, they are
    ordinary text, as in one with encode_special_tokens set.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if added and any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on what is beside them")
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    bpe = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
    return lambda text: np.asarray(bpe.encode_to_numpy(text, allowed_special="all"))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
