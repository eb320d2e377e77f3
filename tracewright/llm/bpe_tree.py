"""Byte-level BPE of whole texts by tree reduction, and decoding.

Encoded pieces of text form a monoid: a join takes the tokens of a left and a right half and gives those of the whole. Two levels do so:

*Bytes of one pattern match.* Halves are cut down to ``SHORT`` bytes, which the ranks' merges encode. A join encodes a window of tokens around
the border again and doubles it until its outermost tokens come out as they were (or the window reaches an end). Then the rest stands: a
sequence of tokens is the encoding of its bytes exactly if every two neighbours encode to themselves; neighbours inside the window
do, as the window was encoded whole, and all others, outermost tokens included, were neighbours before.

*Characters of a text.* Halves are cut down to ``LEAF`` characters, where the pattern is matched and each match encoded as above. A join
matches again from a few matches before the border until a match ends where one of the right half's does, and goes further back as long as the
first match comes out otherwise than before. A match depends on nothing before its start, so what follows stands, and the pattern looks one
character past a match, so what lies before stands too.

A text of more than ``PART`` characters is cut into parts that are rows of their own, so several tasks share it; neighbouring parts are then
joined level by level in the same way, one shuffle of long texts' tokens for each. Decoding concatenates the tokens' bytes up the same tree.

Matches of up to ``SHORT`` bytes that a batch of texts brings up for the first time are merged together, a column operation for each step.
No tokenizer library takes part.

Null texts count as empty (no tokens). Rows keep their order of columns; ids may be null or repeat. The rank file's bytes
travel as a broadcast; its size is fixed by the vocabulary. The sizes above change no token.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.base import Workspace, packed, query, row_key, table

LEAF = 256
SHORT = 16
PART = 1 << 16
_KEPT = 300_000
_SEEN = 64
_NONE = 1 << 60
_FREE = np.int32((1 << 31) - 1)
_loaded: dict = {}


class Bpe:
    """The merges of one rank file; loaded once in each Python process."""

    def __init__(self, data: bytes, pattern: str):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
        self.pattern = regex.compile(pattern)
        self.token = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.bytes = Lists(map(len, self.token), np.frombuffer(b"".join(self.token), np.uint8))
        self.known: dict[str, int] = {}
        self.met = Lists()
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.whole = bool((self.byte_ids >= 0).all())  # otherwise some bytes have no token
        made = [(a, b, rank) for token, rank in self.ranks.items() for a, b in self.cuts_of(token)]
        left, right, made_ids = np.array(made, np.int64).reshape(-1, 3).T
        order = np.argsort(left << 32 | right)
        self.pair_keys, self.pair_ids = (left << 32 | right)[order], made_ids[order].astype(np.int32)

    @staticmethod
    def of(data: bytes, pattern: str) -> Bpe:
        key = hashlib.sha256(data + pattern.encode()).digest()
        if key not in _loaded:
            _loaded[key] = Bpe(data, pattern)
        return _loaded[key]

    def cuts_of(self, token: bytes) -> list[tuple[int, int]]:
        """The pairs of tokens that a token can be merged from."""
        rank = self.ranks.get
        pairs = ((rank(token[:i]), rank(token[i:])) for i in range(1, len(token)))
        return [(a, b) for a, b in pairs if a is not None and b is not None]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what each pair of tokens merges to; ``_FREE`` if it doesn't."""
        if not len(self.pair_keys):
            return np.full(left.shape, _FREE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ids[at], _FREE)

    def merged_together(self, rows: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What ``merged`` gives for each of many rows of the same length: (places of rows, their ids), each row in one of them. A step merges one
        pair in every row that still has one, so rows stay equally wide; those without a pair are finished and leave."""
        ids = self.byte_ids[np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)]
        pairs = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        whose = np.arange(len(rows))
        while len(whose):
            if pairs.shape[1]:
                best = pairs.argmin(axis=1)  # the first of equal ones
                low = pairs[np.arange(len(whose)), best]
                going = low != _FREE
            else:
                going = np.zeros(len(whose), bool)
            if not going.all():
                yield whose[~going], ids[~going]
                if not going.any():
                    break
                whose, ids, pairs, best, low = whose[going], ids[going], pairs[going], best[going], low[going]
            n, width = ids.shape
            row = np.arange(n)
            ids[row, best] = low
            kept = np.ones((n, width), bool)
            kept[row, best + 1] = False
            ids = ids[kept].reshape(n, width - 1)
            kept = np.ones((n, width - 1), bool)
            kept[row, best] = False
            pairs = pairs[kept].reshape(n, width - 2)
            before, after = np.flatnonzero(best > 0), np.flatnonzero(best < width - 2)
            pairs[before, best[before] - 1] = self.pair_ranks(ids[before, best[before] - 1], low[before])
            pairs[after, best[after]] = self.pair_ranks(low[after], ids[after, best[after] + 1])

    def forget(self) -> None:
        """Makes room for the next batch; nodes are good until then."""
        if len(self.met) >= _KEPT or self.met.filled >= 16 * _KEPT:
            self.known.clear()
            self.met.clear()

    def learn(self, matches: set[str]) -> None:
        """Tokens of all short matches not met before; longer ones are left to ``match``."""
        self.forget()
        if not self.whole:
            return
        new = list(matches.difference(self.known))
        data = list(map(str.encode, new))
        whole = np.fromiter((self.ranks.get(x, -1) for x in data), np.int32, count=len(data))
        tokens = np.flatnonzero(whole >= 0)  # a match that is a token is that token, whatever its bytes merge to
        first = self.met.add(np.ones(len(tokens), np.int64), whole[tokens])
        self.known.update(zip([new[i] for i in tokens.tolist()], range(first, first + len(tokens))))
        length = np.where(whole < 0, np.fromiter(map(len, data), np.int64, count=len(data)), 0)
        for n in range(1, SHORT + 1):
            at = np.flatnonzero(length == n).tolist()
            if not at:
                continue
            for rows, ids in self.merged_together([data[i] for i in at]):
                first = self.met.add(np.full(len(rows), ids.shape[1]), ids.ravel())
                self.known.update(zip([new[at[i]] for i in rows.tolist()], range(first, first + len(rows))))

    def merged(self, data: bytes) -> list[bytes]:
        """Tokens of some bytes: the pair of lowest rank is merged, the first of equal ones, again and again."""
        if len(data) > _SEEN:
            return self.merged_by_rank(data)
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        pairs = [rank(data[i : i + 2], _NONE) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != _NONE:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], _NONE)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], _NONE)
        return parts

    def merged_by_rank(self, data: bytes) -> list[bytes]:
        """The same for many bytes. A token ranks after those it is made of, so a merge never brings up a pair of lower rank, and one pass from
        left to right does all merges of a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.ranks.get
        while len(parts) > 1:
            pairs = [rank(a + b, _NONE) for a, b in zip(parts, parts[1:])]
            best = min(pairs)
            if best == _NONE:
                break
            out, i = [], 0
            while i < len(parts):
                if i < len(pairs) and pairs[i] == best:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of two neighbouring runs of bytes, from the tokens of each."""
        size = 1
        while left and right:
            before, after = left[-size:], right[:size]
            window = self.merged(b"".join(before + after))
            if (size >= len(left) or window[0] == before[0]) and (size >= len(right) or window[-1] == after[-1]):
                return left[: max(0, len(left) - size)] + window + right[size:]
            size *= 2
        return left or right

    def halves(self, data: bytes, short: int = SHORT) -> list[bytes]:
        """Tokens of the bytes of one match, from those of its halves."""
        if len(data) <= short:
            return self.merged(data)
        middle = len(data) // 2
        return self.joined(self.halves(data[:middle], short), self.halves(data[middle:], short))

    def match(self, text: str) -> int:
        """Where ``met`` has the tokens of one match of the pattern; a match that is a token is that token."""
        at = self.known.get(text)
        if at is None:
            data = text.encode()
            one = self.ranks.get(data)
            at = self.met.put([one] if one is not None else [self.ranks[t] for t in self.halves(data)])
            if len(text) <= _SEEN:
                self.known[text] = at
        return at

    def leaf(self, text: str, begin: int, end: int, found: list[str] | None = None) -> Node:
        if found is None:
            found = self.pattern.findall(text[begin:end])
        known = self.known
        try:
            matches = list(map(known.__getitem__, found))
        except KeyError:
            matches = list(map(self.match, found))
        cuts = list(accumulate(map(len, found), initial=begin))
        if cuts[-1] != end:  # a pattern that leaves something out between its matches
            cuts = [begin, *(m.end() for m in self.pattern.finditer(text, begin, end))]
        return Node(self, matches, cuts)

    def node(self, text: str, begin: int, end: int, leaf: int = LEAF, found: Iterator[list[str]] | None = None) -> Node:
        """The node of a stretch of text; ``found`` has the matches of its leaves from left to right, if they are known."""
        if end - begin <= leaf:
            return self.leaf(text, begin, end, found and next(found))
        middle = (begin + end) // 2
        left = self.node(text, begin, middle, leaf, found)
        return self.join(text, end, left, self.node(text, middle, end, leaf, found))

    def leaves(self, text: str, begin: int, end: int, leaf: int) -> list[list[str]]:
        """The matches of each leaf, from left to right."""
        if end - begin <= leaf:
            return [self.pattern.findall(text[begin:end])]
        middle = (begin + end) // 2
        return self.leaves(text, begin, middle, leaf) + self.leaves(text, middle, end, leaf)

    def nodes(self, texts: list[str], leaf: int = LEAF) -> Iterator[Node]:
        """The node of each text; what their leaves have not met before is merged together first."""
        found = [self.leaves(text, 0, len(text), leaf) for text in texts]
        self.learn(set(chain.from_iterable(chain.from_iterable(found))))
        for text, of_text in zip(texts, found):
            yield self.node(text, 0, len(text), leaf, iter(of_text))

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        return self.node(text, 0, len(text), leaf).ids

    def join(self, text: str, end: int, left: Node, right: Node) -> Node:
        """The node of both sides; their cuts are places in ``text``, where the right side goes to ``end``."""
        if not left.matches or not right.matches:
            return right if right.matches else left
        back = 2
        while True:
            first = max(0, len(left.matches) - back)
            at, cuts, k = left.cuts[first], [], 0
            while at < end:
                m = self.pattern.search(text, at, end)
                if m is None:
                    k = len(right.matches)
                    break
                at = m.end()
                cuts.append(at)
                while k < len(right.matches) and right.cuts[k] < at:
                    k += 1
                if right.cuts[k] == at:
                    break
            if first == 0 or cuts[0] == left.cuts[first + 1]:
                break
            back *= 2
        known, old, matches = self.known, None, []
        for a, b in zip([left.cuts[first], *cuts], cuts):
            if b - a <= _SEEN:
                at = known.get(text[a:b])
                matches.append(self.match(text[a:b]) if at is None else at)
                continue
            old = old or Node(self, left.matches[first:] + right.matches[:k], left.cuts[first:] + right.cuts[1 : k + 1])
            matches.append(self.long_match(text, a, b, old))
        left.matches[first:] = matches + right.matches[k:]
        left.cuts[first + 1 :] = cuts + right.cuts[k + 1 :]
        return left

    def long_match(self, text: str, begin: int, end: int, old: Node) -> int:
        """``match`` of a long one: if it is made of whole matches of the halves, from their tokens; of any other one, from its bytes."""
        a, b = bisect_left(old.cuts, begin), bisect_left(old.cuts, end)
        if b >= len(old.cuts) or old.cuts[a] != begin or old.cuts[b] != end:
            return self.match(text[begin:end])
        tokens: list[bytes] = []
        for at in old.matches[a:b]:
            tokens = self.joined(tokens, [self.token[i] for i in self.met.get(at)])
        return self.met.put([self.ranks[t] for t in tokens])

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 1 << 14:
            return b"".join(map(self.token.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


class Lists:
    """Many short lists of numbers, one after the other in an array that grows by doubling."""

    def __init__(self, sizes=(), numbers: np.ndarray | None = None):
        self.starts, self.sizes, self.numbers = np.zeros(16, np.int64), np.zeros(16, np.int64), np.zeros(16, np.int32 if numbers is None else numbers.dtype)
        self.count = self.filled = 0
        if numbers is not None:
            self.add(np.array(list(sizes), np.int64), numbers)

    def __len__(self) -> int:
        return self.count

    def clear(self) -> None:
        self.count = self.filled = 0

    def add(self, sizes: np.ndarray, numbers: np.ndarray) -> int:
        """The place of the first of some more lists."""
        first, n, end = self.count, self.count + len(sizes), self.filled + len(numbers)
        if n > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x[:first], np.zeros(2 * n - first, np.int64))) for x in (self.starts, self.sizes))
        if end > len(self.numbers):
            self.numbers = np.concatenate((self.numbers[: self.filled], np.zeros(2 * end - self.filled, self.numbers.dtype)))
        self.starts[first:n] = self.filled + np.cumsum(sizes) - sizes
        self.sizes[first:n] = sizes
        self.numbers[self.filled : end] = numbers
        self.count, self.filled = n, end
        return first

    def put(self, numbers: list[int]) -> int:
        return self.add(np.array([len(numbers)]), np.array(numbers, self.numbers.dtype))

    def get(self, at: int) -> list[int]:
        return self.numbers[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()

    def joined(self, places: np.ndarray) -> np.ndarray:
        """The numbers of the lists at some places, one after the other; a piece at a time, as each number takes a place of its own meanwhile."""
        out = []
        for i in range(0, len(places), 1 << 18):
            some = places[i : i + (1 << 18)]
            sizes = self.sizes[some]
            ends = np.cumsum(sizes)
            out.append(self.numbers[np.repeat(self.starts[some] - (ends - sizes), sizes) + np.arange(ends[-1])])
        return np.concatenate(out) if out else self.numbers[:0]


@dataclass
class Node:
    """Where ``met`` has the tokens of each match of a stretch of text, and where its matches are cut (its begin, then the end of each)."""

    bpe: Bpe
    matches: list[int]
    cuts: list[int]

    @property
    def ids(self) -> list[int]:
        return self.bpe.met.joined(np.array(self.matches, np.int64)).tolist()

    @property
    def sizes(self) -> list[int]:
        return self.bpe.met.sizes[np.array(self.matches, np.int64)].tolist()

    @staticmethod
    def of(bpe: Bpe, ids: list[int], cuts: list[int], sizes: list[int]) -> Node:
        first = bpe.met.add(np.array(sizes, np.int64), np.array(ids, np.int32))
        return Node(bpe, list(range(first, first + len(sizes))), cuts)


def _offsets(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def _nodes_array(bpe: Bpe, nodes: list[Node]) -> pa.Array:
    """The tokens of each node."""
    places = np.fromiter(chain.from_iterable(n.matches for n in nodes), np.int64)
    ends = _offsets(bpe.met.sizes[places])[_offsets([len(n.matches) for n in nodes])]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bpe.met.joined(places)))


def _ids_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int32)
    flat = np.fromiter(chain.from_iterable(lists), np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _replaced(batch: pa.RecordBatch, drop: set[str], name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [c for c in batch.schema.names if c not in drop]
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column], names=[*keep, name])


def _encoder(data, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(data.value, pattern)
        for batch in (b for big in batches for b in packed([big], "text", 2 << 20)):
            nodes = list(bpe.nodes([t or "" for t in batch.column("text").to_pylist()]))
            yield _replaced(batch, {"text"}, "ids", _nodes_array(bpe, nodes))

    return run


_LEVEL = "ka long, kb long, i int, ids array<int>, cuts array<int>, sizes array<int>"


def _level_batch(batch: pa.RecordBatch, drop: set[str], nodes: list[Node]) -> pa.RecordBatch:
    out = _replaced(batch, drop, "ids", _ids_array([n.ids for n in nodes]))
    rest = [_ids_array([n.cuts for n in nodes]), _ids_array([n.sizes for n in nodes])]
    return pa.RecordBatch.from_arrays([*out.columns, *rest], names=[*out.schema.names, "cuts", "sizes"])


def _part_encoder(data, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(data.value, pattern)
        for batch in (b for big in batches for b in packed([big], "text", 2 << 20)):
            yield _level_batch(batch, {"text"}, list(bpe.nodes(batch.column("text").to_pylist())))

    return run


def _joiner(data, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(data.value, pattern)
        for big in batches:
            for i in range(big.num_rows):
                batch = big.slice(i, 1)
                pair = batch.column("pair").to_pylist()[0]
                bpe.forget()
                node = Node.of(bpe, pair[0]["ids"], pair[0]["cuts"], pair[0]["sizes"])
                if len(pair) == 2:
                    left, right = (bpe.decode(p["ids"]).decode() for p in pair)
                    text = left + right
                    node = bpe.join(text, len(text), node, Node.of(bpe, pair[1]["ids"], [c + len(left) for c in pair[1]["cuts"]], pair[1]["sizes"]))
                yield _level_batch(batch, {"pair"}, [node])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """(row, text): all other columns as one struct beside the text."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), docs["text"].cast("string").alias("text"))


def _length():
    return F.coalesce(F.length("text"), F.lit(0))


def _encode_long(long: DataFrame, data, pattern: str, part: int) -> DataFrame | None:
    """(row, ids) of texts longer than a part, None if there is none."""
    most = long.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return None
    ws = Workspace(long.sparkSession, "bpe")
    keyed = long.select("row", "text", *row_key(F.lit(None).cast("long"), F.col("text")))
    parts = (
        keyed.dropDuplicates(["ka", "kb"])
        .select("ka", "kb", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / part).cast("int"))).alias("i"))
        .select("ka", "kb", "i", F.substring("text", F.col("i") * part + 1, F.lit(part)).alias("text"))
        .repartition("ka", "kb", "i")
    )
    level = ws.write(parts.mapInArrow(_part_encoder(data, pattern), _LEVEL), "parts")
    count = -(-most // part)
    while count > 1:
        pairs = level.groupBy("ka", "kb", F.expr("i div 2").cast("int").alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "ids", "cuts", "sizes"))).alias("pair"))
        above = ws.write(pairs.mapInArrow(_joiner(data, pattern), _LEVEL), "level")
        ws.drop(level)
        level, count = above, -(-count // 2)
    level = ws.result(level.drop("cuts", "sizes"))
    return keyed.join(level, ["ka", "kb"]).select("row", "ids")


def encode(docs: DataFrame, rank_file: str, pattern: str, part: int = PART) -> DataFrame:
    """``docs`` as a struct ``row``, with ``ids`` array<int>: the tokens of its text."""
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = _rows(docs)
    kind = rows.schema["row"].dataType.simpleString()
    short = rows.where(_length() <= part).mapInArrow(_encoder(data, pattern), f"row {kind}, ids array<int>")
    long = _encode_long(rows.where(_length() > part), data, pattern, part)
    return short if long is None else short.unionByName(long)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a list column without nulls, and where each list begins and ends among them."""
    return lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _decoder(data, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(data.value, pattern)
        for big in batches:
            for start in range(0, big.num_rows, 256):
                batch = big.slice(start, 256)
                ids, cut = _flat(batch.column("ids"))
                flat = bpe.bytes.joined(ids).tobytes()
                ends = _offsets(bpe.bytes.sizes[ids])[cut].tolist()
                texts = pa.array([flat[a:b] for a, b in zip(ends, ends[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` binary: the bytes its ``ids`` stand for."""
    with open(rank_file, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoder(data, pattern), f"{fields}, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit integers) and decoded_sha256 instead of ids and decoded."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for batch in batches:
        ids = batch.column("ids")
        numbers, cut = _flat(ids)
        numbers, cut = numbers.astype("<u4"), cut.tolist()
        keep = [c for c in batch.schema.names if c not in ("ids", "decoded")]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in keep),
                pa.array(np.diff(cut), pa.int64()),
                pa.array([sha(numbers[a:b].tobytes()) for a, b in zip(cut, cut[1:])], pa.string()),
                pa.array([sha(d) for d in batch.column("decoded").to_pylist()], pa.string()),
            ],
            names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def _steps(*steps):
    """Generators one after the other in one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in steps:
            batches = step(batches)
        return batches

    return run


def encode_and_decode(docs: DataFrame, rank_file: str, pattern: str, part: int = PART) -> DataFrame:
    """Digests of tokens and of the text decoded from them, with every other column of ``docs``; columns that had the new
    names are replaced."""
    with open(rank_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = _rows(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"))
    back = f"row {rows.schema['row'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    after = (_decoder(data, pattern), _digests)
    out = rows.where(_length() <= part).mapInArrow(_steps(_encoder(data, pattern), *after), back)
    long = _encode_long(rows.where(_length() > part), data, pattern, part)
    if long is not None:
        out = out.unionByName(long.mapInArrow(_steps(*after), back))
    return out.select("row.*", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op9_bpe_tree")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
