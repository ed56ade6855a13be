"""Byte-level BPE by speculation: greedy longest matches are proposed, adjacent pairs verified, failures merged exactly."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from threadloom.llm.common import documents, ship

#: The pattern of the byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker remembers the ids of so many pre-tokens, then starts anew.
CACHE = 500_000

_SHIFT = (1 << 24) - 1


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_tokenizer(path: str) -> dict:
    """The vocabulary (bytes by id), merges (pairs of ids with their result, in order) and special tokens of a file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars, vocab = byte_characters(), spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    of_id = {i: bytes(chars[c] for c in t) for t, i in vocab.items() if t not in special}
    of_id |= {i: t.encode() for t, i in special.items()}
    merges = []
    for m in spec["model"]["merges"]:
        a, b = m.split(" ") if isinstance(m, str) else m
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    return {"bytes": [of_id.get(i, b"") for i in range(max(of_id) + 1)], "merges": merges, "special": special}


class Bpe:
    """Encoder and decoder over the tables of read_tokenizer()."""

    def __init__(self, spec: dict):
        import regex

        self.bytes, self.special = spec["bytes"], spec["special"]
        self.text = [str(i) for i in range(len(self.bytes))]
        n = len(self.bytes)
        specials = set(self.special.values())
        self.ids = {t: i for i, t in enumerate(self.bytes) if t and i not in specials}
        merges = np.array(spec["merges"], dtype=np.int64).reshape(-1, 3)
        rank = np.arange(len(merges))
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges.tolist())}
        # Rank and result in one number, whose order is that of the ranks.
        self.code = {pair: r * (_SHIFT + 1) + c for pair, (r, c) in self.rank.items()}
        # How each token came about: its halves and the rank of its merge; single bytes have no halves.
        self.left, self.right = np.full(n, -1), np.full(n, -1)
        self.born = np.full(n, -1)
        back = merges[::-1]
        self.left[back[:, 2]], self.right[back[:, 2]], self.born[back[:, 2]] = back[:, 0], back[:, 1], rank[::-1]
        keys = merges[:, 0] * n + merges[:, 1]
        order = np.argsort(keys)
        self.keys, self.key_rank, self.n = keys[order], rank[order], n
        # A token that its own bytes do not merge into can never be proposed.
        self.never = {i for t, i in self.ids.items() if len(t) > 1 and self.born[i] < 0}
        for i in self.never:
            del self.ids[self.bytes[i]]
        # The longest token that starts with four bytes, so that no longer match is looked for.
        self.longest: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > 3:
                self.longest[t[:4]] = max(len(t), self.longest.get(t[:4], 3))
        self.byte_ids = [self.ids.get(bytes([x]), -1) for x in range(256)]
        self.find = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.merged = self.proposed = 0

    # -- speculation ------------------------------------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest matches from the left; every single byte is a token."""
        ids, longest, out, a, n = self.ids, self.longest, [], 0, len(word)
        while a < n:
            b = a + longest.get(word[a : a + 4], 3)
            if b > n:
                b = n
            while (found := ids.get(word[a:b])) is None:
                b -= 1
                if b == a:
                    raise ValueError("the vocabulary lacks a byte")
            out.append(found)
            a = b
        return out

    # -- verification -----------------------------------------------------------------------------

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a large number."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(a), 1 << 40)
        return np.where(self.keys[at] == key, self.key_rank[at], 1 << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether BPE leaves each token pair (a, b) apart when it sees their bytes joined.

        Undo the merges of both tokens from the latest to the earliest. Between two undone merges the tokens that
        touch at the seam stand next to each other; had they a merge that comes earlier than the next merge to touch
        either of them, BPE would have joined across the seam.
        """
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        # Merges of rank below `until` were applied while a and b touched; at the start, all of them.
        until = np.full(len(a), 1 << 40)
        while len(live):
            x, y = a[live], b[live]
            # A tie between the seam and the right token's own merge goes to the seam, which is further left.
            joined = self.ranks(x, y) < until[live]
            good[live[joined]] = False
            live, x, y = live[~joined], x[~joined], y[~joined]
            bx, by = self.born[x], self.born[y]
            undo_left = bx > by
            over = (bx < 0) & (by < 0)
            until[live] = np.where(undo_left, bx, by + 1)
            a[live] = np.where(undo_left & ~over, self.right[x], x)
            b[live] = np.where(~undo_left & ~over, self.left[y], y)
            live = live[~over]
        return good

    # -- exact merging ----------------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """BPE as defined: join the pair of the least rank, leftmost first, until no pair has a rank."""
        ids = [self.byte_ids[x] for x in word]
        return self._merge_long(ids) if len(ids) > 40 else self._merge_short(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """By looking for the least rank in the list of pairs, which is quick for a few bytes."""
        code, none, shift = self.code.get, 1 << 60, _SHIFT
        pairs = [code(p, none) for p in zip(ids, ids[1:])]
        while pairs:
            best = min(pairs)
            if best == none:
                break
            k = pairs.index(best)
            found = ids[k] = best & shift
            del ids[k + 1], pairs[k]
            if k:
                pairs[k - 1] = code((ids[k - 1], found), none)
            if k < len(pairs):
                pairs[k] = code((found, ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """By a heap of candidate pairs over a linked list, so that long pre-tokens take n log n steps."""
        import heapq

        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for k in range(n - 1):
            if (found := self.rank.get((ids[k], ids[k + 1]))) is not None:
                heap.append((found[0], k, ids[k], ids[k + 1]))
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            m = after[k]
            if ids[k] != x or m >= n or ids[m] != y:
                continue
            ids[k], ids[m] = self.rank[(x, y)][1], -1
            after[k] = after[m]
            if after[k] < n:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right < n and (found := self.rank.get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (found[0], left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    # -- texts ------------------------------------------------------------------------------------

    def learn(self, words: Iterable[str]) -> None:
        """Encode pre-tokens into the cache: all proposals first, then one vectorised check of their pairs."""
        words = list(words)
        if not words:
            return
        raw = [w.encode() for w in words]
        proposals = [self.propose(w) for w in raw]
        flat = np.fromiter(chain.from_iterable(proposals), dtype=np.int64)
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        owner = np.repeat(np.arange(len(words)), sizes)
        pairs = np.flatnonzero(owner[1:] == owner[:-1])
        keys, inverse = np.unique(flat[pairs] * self.n + flat[pairs + 1], return_inverse=True)
        fine = self.compatible(keys // self.n, keys % self.n)[inverse]
        failed = set(owner[pairs[~fine]].tolist())
        self.proposed += len(words)
        self.merged += len(failed)
        for k, (word, ids) in enumerate(zip(words, proposals)):
            self.cache[word] = tuple(self.merge(raw[k])) if k in failed else tuple(ids)

    def trim(self) -> None:
        """Forget all pre-tokens once there are too many."""
        if len(self.cache) > CACHE:
            self.cache.clear()

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens."""
        return self.find(text)

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text; strings of special tokens become their ids."""
        parts = [self.split(t) if self.split and any(s in t for s in self.special) else [t] for t in texts]
        found = [[(p,) if p in self.special else self.find(p) for p in ps] for ps in parts]
        new = set()
        for ps in found:
            for p in ps:
                new.update(p)
        self.trim()
        self.learn(w for w in new if w not in self.cache and w not in self.special)
        cache = self.cache
        for ps in found:
            ids: list[int] = []
            for p in ps:
                if isinstance(p, tuple):
                    ids.append(self.special[p[0]])
                else:
                    ids.extend(chain.from_iterable(map(cache.__getitem__, p)))
            yield ids

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_models: dict[int, Bpe] = {}


def model(tables) -> Bpe:
    """The worker's model for a broadcast of tables."""
    if tables.id not in _models:
        _models.clear()
        _models[tables.id] = Bpe(tables.value)
    return _models[tables.id]


class Tables:
    """The tables of a tokenizer file, whose size the file bounds, broadcast with an id to find them again."""

    def __init__(self, spark: SparkSession, path: str):
        self.broadcast = spark.sparkContext.broadcast(read_tokenizer(path))
        self.id = f"{spark.sparkContext.applicationId}-{self.broadcast._jbroadcast.id()}"

    @property
    def value(self) -> dict:
        return self.broadcast.value

    def __getstate__(self):
        return {"broadcast": self.broadcast, "id": self.id}


#: Texts are encoded in groups of about so many characters.
GROUP_CHARACTERS = 1 << 20


def groups(sizes: Iterable[int], limit: int = GROUP_CHARACTERS) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of rows with about limit characters, at least one row each."""
    a = b = total = 0
    for size in sizes:
        if b > a and total + size > limit:
            yield a, b
            a, total = b, 0
        b, total = b + 1, total + size
    if b > a:
        yield a, b


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id, ids (array of int), decoded (the text that the ids give back).

    tokenizer: the path of a byte-level BPE file, read on the driver. Null counts as empty (no ids); rows that repeat
    are each encoded; an empty table gives an empty result; columns other than the two named are ignored. Each
    task keeps one group of texts and the model in memory; a single text is taken whole, however long.
    """
    return _mapped(docs, tokenizer, id_column, text_column, "ids array<int>, decoded string", lambda t: {
        "ids": pa.array([x for x, _ in t], pa.list_(pa.int32())), "decoded": pa.array([d for _, d in t], pa.string())
    })


def encode_digests(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """As encode_documents(), but n_tokens, ids_sha256 and decoded_sha256 in place of the ids and the text."""
    return _mapped(docs, tokenizer, id_column, text_column, "n_tokens long, ids_sha256 string, decoded_sha256 string", None)


def _mapped(docs: DataFrame, tokenizer: str, id_column: str, text_column: str, schema: str, columns) -> DataFrame:
    ship(docs.sparkSession)
    tables = Tables(docs.sparkSession, tokenizer)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        bpe = model(tables)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, b in groups(sizes):
                part = [t or "" for t in texts.slice(a, b - a).to_pylist()]
                found = ((x, bpe.decode(x)) for x in bpe.encode_batch(part))
                if columns:
                    rest = columns(list(found))
                else:
                    rows = [
                        (len(x), hashlib.sha256(",".join(map(bpe.text.__getitem__, x)).encode()).hexdigest(), hashlib.sha256(d.encode()).hexdigest())
                        for x, d in found
                    ]
                    rest = {
                        "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                        "ids_sha256": pa.array([r[1] for r in rows], pa.string()),
                        "decoded_sha256": pa.array([r[2] for r in rows], pa.string()),
                    }
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *rest.values()], names=[id_column, *rest])

    import pyarrow.compute  # noqa: F401  binds pa.compute

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, {schema}")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), default_tokenizer())
