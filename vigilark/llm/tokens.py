"""Token ids of whole Arrow columns with a public byte-level BPE."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
END = 50256
# Fixed value: the pattern that this vocabulary's tokenizer parts texts with.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=2)
def encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The tokenizer of a vocabulary file, and which ids start with a space."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    spaced = np.zeros(max(ranks.values()) + 2, bool)
    spaced[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), spaced


def encode(texts: list[str | None], path: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """All ids in a row, and how many each text has; a null is an empty text.

    A single space between other characters always starts a new piece of the pattern, so texts
    are cut there and each distinct part is encoded once. Texts with other spacing are encoded as they are.
    """
    bpe, spaced = encoding(path)
    parts: list[str] = []
    many = np.zeros(len(texts), np.int64)
    heads: list[list[int]] = []
    for i, text in enumerate(texts):
        first, *rest = (text or "").split(" ")
        if text and (text[0].isspace() or text[-1].isspace() or first[-1:].isspace()):
            rest = []
            heads.append(bpe.encode_ordinary(text))
        else:
            heads.append(bpe.encode_ordinary(first))
            parts += rest
        many[i] = len(rest)
    codes, distinct = pd.factorize(np.array(parts, object)) if parts else (np.zeros(0, np.int64), np.zeros(0, object))
    odd = np.fromiter((not p or p[0].isspace() or p[-1].isspace() for p in distinct), bool, len(distinct))
    owner = np.repeat(np.arange(len(texts)), many)
    if odd.any():
        bad = np.unique(owner[odd[codes]])
        for i in bad:
            heads[i] = bpe.encode_ordinary(texts[i])
        keep = ~np.isin(owner, bad)
        codes, owner = codes[keep], owner[keep]
    joined = np.array(bpe.encode_ordinary(" " + " ".join("x" if o else p for p, o in zip(distinct, odd))) if len(distinct) else [], np.int64)
    starts = np.flatnonzero(spaced[joined])
    if len(starts) != len(distinct):
        raise ValueError("the vocabulary's pattern does not part texts at single spaces")
    lengths = np.diff(np.r_[starts, len(joined)])
    head_lengths = np.array([len(h) for h in heads], np.int64)
    # Each text is its head and then its parts: source positions in one table of ids.
    table = np.concatenate([joined, np.fromiter((x for h in heads for x in h), np.int64, int(head_lengths.sum()))])
    head_at = len(joined) + np.cumsum(head_lengths) - head_lengths
    order = np.argsort(np.r_[np.arange(len(texts)), owner], kind="stable")
    begin = np.r_[head_at, starts[codes]][order]
    long = np.r_[head_lengths, lengths[codes]][order]
    ids = table[np.arange(int(long.sum())) + np.repeat(begin - (np.cumsum(long) - long), long)]
    total = head_lengths + np.bincount(owner, lengths[codes], len(texts)).astype(np.int64)
    return ids.astype(np.uint16 if len(spaced) <= 65536 else np.uint32), total
