"""Problem 7: token ids of a public byte-level tokenizer."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# The code points with the Unicode property White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What the tokenizer splits off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
LETTER, NUMBER, OTHER, WHITESPACE = 0, 1, 2, 3

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    if not _CLASSES:
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                table[c] = LETTER
            elif k == "N":
                table[c] = NUMBER
        table[WHITE] = WHITESPACE
        _CLASSES.append(table)
    return _CLASSES[0]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a pre-token begins, for the code points of many texts one behind the other.

    ``first`` marks the first code point of each text. A code point's transition either resets the place where the
    current run of white space ends or leaves it as it is; such functions compose associatively, so one scan from
    the right gives every run its end. All else depends on the classes of the neighbours: a run of letters,
    of numbers or of other signs takes one blank before it, white space before a text's end stays whole, and the
    endings after an apostrophe are cut off where the apostrophe itself begins a pre-token.
    """
    n = len(points)
    if not n:
        return np.zeros(0, dtype=bool)
    kind = classes()[points]
    white, blank = kind == WHITESPACE, points == 0x20
    last = np.append(first[1:], True)
    before = np.where(first, 255, np.append(np.uint8(255), kind[:-1]))
    # the scan: the end of the run of white space that holds a place, and whether the text ends there
    ends = white & np.append(~white[1:], True) | white & last
    where = np.where(ends, np.arange(n), n)
    end = np.minimum.accumulate(where[::-1])[::-1]
    to_end = white & last[np.minimum(end, n - 1)]
    is_last = white & ends
    # white space: a run begins a pre-token; its last code point begins one too, unless the text ends there
    begin_white = white & ((before != WHITESPACE) | is_last & ~to_end)
    joined = np.append(False, (blank & is_last & ~to_end)[:-1]) & ~first
    begin = begin_white | ~white & (before != kind) & ~joined
    # endings after an apostrophe that begins a pre-token
    quote = np.flatnonzero((points == 0x27) & begin)
    if len(quote):
        padded = np.append(points, [0, 0, 0])
        stop = np.append(first, [True, True, True])
        one, two = padded[quote + 1], padded[quote + 2]
        ok1 = ~stop[quote + 1]
        ok2 = ok1 & ~stop[quote + 2]
        length = np.zeros(len(quote), dtype=np.int64)
        for e in ENDINGS:
            hit = ok1 & (one == ord(e)) if len(e) == 1 else ok2 & (one == ord(e[0])) & (two == ord(e[1]))
            length = np.where((length == 0) & hit, len(e), length)
        at, length = quote[length > 0], length[length > 0]
        begin[at + 1] = False
        after = at + 1 + length
        inside = after[after < n]
        begin[inside] = True
        # a blank or a run that begins there anyway stays as it is; only letters within a run are cut
    begin[first] = True
    return begin


def load_ranks(path: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: neighbours are merged by rank, lowest first, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))
    back = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != e or end[i] == e:
            continue
        j = end[i]
        alive[j] = False
        end[i] = e
        if e < n:
            back[e] = i
            r = ranks.get(piece[i : end[e]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[e]))
        p = back[i]
        if p >= 0:
            r = ranks.get(piece[p:e])
            if r is not None:
                heapq.heappush(heap, (r, p, e))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def encode_batch(texts: list[str | None], ranks: dict[bytes, int], cache: dict[str, list[int]], offsets: bool = False) -> list:
    """The ids of each text; with ``offsets`` also the places (in code points) where its pre-tokens begin."""
    sizes = [len(t) if t else 0 for t in texts]
    joined = "".join(t for t in texts if t)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    first = np.zeros(len(points), dtype=bool)
    first[starts[:-1][np.array(sizes, dtype=np.int64) > 0]] = True
    cuts = np.flatnonzero(boundaries(points, first))
    edge = np.searchsorted(cuts, starts)
    cuts = [*cuts.tolist(), len(points)]
    out = []
    for k in range(len(texts)):
        ids: list[int] = []
        for c in range(edge[k], edge[k + 1]):
            word = joined[cuts[c] : cuts[c + 1]]
            got = cache.get(word)
            if got is None:
                got = merge(word.encode("utf-8", "surrogatepass"), ranks)
                if len(word) <= 64:
                    if len(cache) > 500_000:
                        cache.clear()
                    cache[word] = got
            ids += got
        out.append((ids, [cuts[c] - int(starts[k]) for c in range(edge[k], edge[k + 1])]) if offsets else ids)
    return out


def decode(ids: list[int], names: list[bytes]) -> str:
    """The text of ids; ``names`` has the bytes of each id."""
    return b"".join(names[i] for i in ids).decode("utf-8", "replace")


def _parts(texts: list, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` code points; a longer text is a range of its own."""
    a = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield a, i
            a, size = i, 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def encode(documents: DataFrame, path: str = DEFAULT_RANKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, ids, starts``: the token ids of every text without special tokens, and the place of each pre-token.

    The rank table has a fixed size (50,256 entries) and is broadcast, so executors need no copy of the file.
    Null and empty texts have an empty list; strings of control tokens are ordinary text; long texts are encoded
    whole. Repeated rows give repeated rows.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, cache = ranks.value, {}
        for b in batches:
            texts = b["text"].tolist()
            for i, j in _parts(texts):
                got = encode_batch(texts[i:j], table, cache, offsets=True)
                yield pd.DataFrame({"key": b["key"].iloc[i:j].to_numpy(), "ids": [x for x, _ in got], "starts": [x for _, x in got]})

    rows = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInPandas(run, f"key {kind}, ids array<int>, starts array<int>").withColumnRenamed("key", key)


def token_counts(documents: DataFrame, path: str = DEFAULT_RANKS, text: str = "text") -> DataFrame:
    """``documents`` with ``n_tokens``; null and empty texts have 0."""
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(path))

    @F.pandas_udf("bigint")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table, cache = ranks.value, {}
        for s in parts:
            texts = s.tolist()
            sizes: list[int] = []
            for i, j in _parts(texts):
                sizes += [len(x) for x in encode_batch(texts[i:j], table, cache)]
            yield pd.Series(sizes, dtype="int64")

    return documents.withColumn("n_tokens", count(F.col(f"`{text}`")))
