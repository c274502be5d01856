"""Word shingles of Arrow text columns, as sorted distinct 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from tamarisk.llm.arrow import texts_of

SHINGLE = 5


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text: n + 1 offsets, a code for each word, and the distinct words that the codes number.

    A-Z are lower-cased; words are maximal runs without space, tab, line feed, vertical tab, form feed and carriage
    return. Nulls have no words.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts_of(texts)))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:
        keep = codes != blank
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return offsets, codes, coded.dictionary


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads differences over all bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingle hashes, sorted. Fewer words than size: one shingle; no words: none."""
    offsets, codes, words = split_words(texts)
    by_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))
    hashed = by_word[codes] if len(codes) else np.zeros(0, np.uint64)
    whole = max(0, len(hashed) - size + 1)
    grams = np.zeros(whole, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size if whole else 0):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashed[j : j + whole]
        grams = mixed(grams)
    out = []
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if end - start >= size:
            out.append(np.unique(grams[start : end - size + 1]))
        elif end > start:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashed[start:end].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
