"""Plain computations that several tests of the text operators hold results against."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter

import public_tokenizers


def held(i: int, n: int, r: int) -> bool:
    return zlib.crc32(str(i).encode()) % n == r


def kept_words(texts: list[str], window: int) -> list[tuple[int, list[bytes]]]:
    words = [t.encode().split() for t in texts]
    starts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if starts[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), [x for i, x in enumerate(w) if i not in gone]))
    return out


def tiktoken_rows(texts: dict) -> dict:
    import numpy as np
    import tiktoken

    lines = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encode = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return {i: (len(x := encode(t)), sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, t in texts.items()}


def any_item(text: str | None, items: list[str | None], size: int = 5) -> bool:
    """Whether some window as long as an item shares three quarters of the shingles of both (as bags)."""

    def bag(words: list[bytes]) -> Counter:
        return Counter(tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1)))

    words = (text or "").encode().lower().split()
    seen = set(words)
    for item in items:
        own = (item or "").encode().lower().split()
        if not own or len(words) < min(len(own), size) or 2 * len(seen & set(own)) < len(set(own)):
            continue
        want = bag(own)
        for start in range(max(1, len(words) - len(own) + 1)):
            have = bag(words[start : start + len(own)])
            shared = sum((want & have).values())
            if 100 * shared >= 75 * (sum(want.values()) + sum(have.values()) - shared):
                return True
    return False
