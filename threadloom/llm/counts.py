"""Token counts under edits: a kept segment tree of pre-token counts per document, re-encoded only where edits touch it."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.bpe import Bpe, Tables, default_tokenizer, groups, model
from threadloom.llm.common import documents, saved, ship

#: Pre-tokens in a leaf of the tree.
LEAF = 16
#: So few new pre-tokens, as after an edit, are merged exactly at once: checking proposals pays for many.
FEW = 32
#: How many characters past its end a pre-token's match may depend on (contractions take three, from an apostrophe on).
REACH = 2

EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def split_text(bpe: Bpe, text: str) -> list[str]:
    """Pre-tokens of a text; strings of special tokens stand alone."""
    if not bpe.split or not any(s in text for s in bpe.special):
        return bpe.pieces(text)
    out: list[str] = []
    for part in bpe.split(text):
        out.extend([part] if part in bpe.special else bpe.pieces(part))
    return out


def know(bpe: Bpe, texts: list[list[str]]) -> None:
    """Have bpe learn all pre-tokens of some texts at once. A special token's string is never an ordinary pre-token."""
    for s, i in bpe.special.items():
        bpe.cache[s] = (i,)
    new = set()
    for pieces in texts:
        new.update(pieces)
    new = [w for w in new if w not in bpe.cache]
    if len(new) < FEW:
        for w in new:
            bpe.cache[w] = tuple(bpe.merge(w.encode()))
    else:
        bpe.learn(new)


class CountTree:
    """Sums of characters and tokens over runs of pre-tokens, in a binary tree over leaves of about LEAF pre-tokens.

    An edit costs the leaves that it touches and a path to the root. Pre-tokens are found from left to right and depend on what
    follows their start only, so from any old boundary on the old pre-tokens stand as long as the text there is unchanged. New
    pre-tokens are dealt over the leaves that they replace; where these would hold over 2 * LEAF of them, or half of all leaves
    stand empty, the tree is laid out anew, so that its depth follows the text it holds. A tree is kept as its leaves' sums.
    """

    def __init__(self, bpe: Bpe, text: str, characters: np.ndarray, tokens: np.ndarray):
        """characters and tokens: the sums of each leaf, as build() or a former tree's leaves() gives them."""
        self.bpe, self.text, self.recounted = bpe, text, 0
        self._lay_out(np.asarray(characters, np.int64), np.asarray(tokens, np.int64))

    @classmethod
    def build(cls, bpe: Bpe, text: str) -> CountTree:
        pieces = split_text(bpe, text)
        know(bpe, [pieces])
        return cls(bpe, text, *leaf_sums(bpe, pieces))

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the leaves that hold anything."""
        c, t = (x[self.size : self.size + self.n_leaves] for x in (self.characters, self.tokens))
        return c[c > 0], t[c > 0]

    def _lay_out(self, characters: np.ndarray, tokens: np.ndarray) -> None:
        self.n_leaves, self.empty = max(1, len(characters)), 0
        self.size = 1 << (self.n_leaves - 1).bit_length()
        self.characters, self.tokens = np.zeros(2 * self.size, np.int64), np.zeros(2 * self.size, np.int64)
        for sums, leaves in ((self.characters, characters), (self.tokens, tokens)):
            sums[self.size : self.size + len(leaves)] = leaves
            level = self.size
            while level > 1:
                sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
                level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def length(self) -> int:
        return int(self.characters[1])

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character position, and where the leaf starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if position >= start + self.characters[node]:
                start += int(self.characters[node])
                node += 1
        return node - self.size, start

    def _set(self, k: int, characters: int, tokens: int) -> None:
        node = self.size + k
        self.empty += int(characters == 0) - int(self.characters[node] == 0)
        self.characters[node], self.tokens[node] = characters, tokens
        node //= 2
        while node:
            for sums in (self.characters, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]
            node //= 2

    def _size(self, k: int) -> int:
        return int(self.characters[self.size + k])

    def edit(self, start: int, end: int, text: str) -> None:
        """Replace the characters [start, end), cut to the document, by text."""
        start = min(max(0, start), self.length)
        end = min(max(start, end), self.length)
        special = max(map(len, self.bpe.special), default=0)
        reach = max(REACH, special)
        a, at = self._find(max(0, min(start - reach, self.length - 1)))
        a = min(a, self.n_leaves - 1)
        following, stop = a + 1, at + self._size(a)
        while stop < end:
            stop += self._size(following)
            following += 1
        new = self.text[at:start] + text + self.text[end:stop]
        # Take in leaves on the right until a new boundary falls on an old one past the edit.
        while True:
            n, far = following, stop
            while n < self.n_leaves and far - stop <= reach:
                far += self._size(n)
                n += 1
            beyond = self.text[stop:far]
            pieces, length, taken = split_text(self.bpe, new + beyond), 0, []
            for p in pieces:
                if length >= len(new):
                    break
                taken.append(p)
                length += len(p)
            if length == len(new) and (not beyond or not self._torn(new, beyond)):
                break
            new += self.text[stop : stop + self._size(following)]
            stop += self._size(following)
            following += 1
        know(self.bpe, [taken])
        self.recounted += len(taken)
        self.text = self.text[:start] + text + self.text[end:]
        old = following - a
        if len(taken) <= 2 * LEAF * old:
            characters, tokens = leaf_sums(self.bpe, taken, max(LEAF, -(-len(taken) // old)))
            for k in range(old):
                self._set(a + k, *((int(characters[k]), int(tokens[k])) if k < len(characters) else (0, 0)))
            if 2 * self.empty > self.n_leaves:
                self._lay_out(*self.leaves())
            return
        keep = [x[self.size : self.size + self.n_leaves] for x in (self.characters, self.tokens)]
        self._lay_out(*(np.concatenate([x[:a], m, x[following:]]) for x, m in zip(keep, leaf_sums(self.bpe, taken))))

    def _torn(self, new: str, beyond: str) -> bool:
        """Whether a special token's string lies across the seam."""
        return any(s in new[-len(s) + 1 :] + beyond[: len(s) - 1] for s in self.bpe.special)


def leaf_sums(bpe: Bpe, pieces: list[str], size: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tokens of each run of size pre-tokens, all of which are known to bpe."""
    if not pieces:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, n = np.arange(0, len(pieces), size), len(pieces)
    characters = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, n), starts)
    return characters, np.add.reduceat(np.fromiter(map(len, map(bpe.cache.__getitem__, pieces)), np.int64, n), starts)


#: The columns that hold a document's tree: its leaves' sums.
TREE = "n_tokens long, characters array<int>, tokens array<int>"


def _tree_arrays(counts: list[int], leaves: list[tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(c) for c, _ in leaves])]).astype(np.int32))
    flat = [np.concatenate([x[k] for x in leaves]).astype(np.int32) if leaves else np.zeros(0, np.int32) for k in (0, 1)]
    return [pa.array(counts, pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat)]


def count_trees(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: the id, the text (null as empty), n_tokens, and its tree as characters and tokens of every leaf.

    The result is meant to be kept as a table: edits are then counted from it without encoding the documents again. Repeated
    rows have a tree each; other columns are left out; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    tables = Tables(docs.sparkSession, tokenizer)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]):
        bpe = model(tables)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in groups(map(len, texts)):
                bpe.trim()
                split = [split_text(bpe, x) for x in texts[a:b]]
                know(bpe, split)
                leaves = [leaf_sums(bpe, pieces) for pieces in split]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(texts[a:b], pa.string()), *_tree_arrays([int(t.sum()) for _, t in leaves], leaves)],
                    names=[id_column, text_column, "n_tokens", "characters", "tokens"],
                )

    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, `{text_column}` string, {TREE}")


def edited_trees(trees: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", edits_column: str = "edits") -> DataFrame:
    """count_trees() after edits, with n_tokens_before, n_edits and n_recounted (pre-tokens that were encoded again).

    trees: rows of count_trees() or of this, with edits: an array of (start, end, text), applied in order, each to the result of
    those before it; positions are in characters and cut to the document; null edits and null members leave it as it is, null text
    inserts nothing. Documents without edits pass through with their trees. A task holds the tree of one document at a time.
    """
    ship(trees.sparkSession)
    tables = Tables(trees.sparkSession, tokenizer)
    kind = trees.schema[id_column].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]):
        bpe = model(tables)
        for batch in batches:
            edit_lists, before = batch.column(5).to_pylist(), batch.column(2).to_pylist()
            texts, sums = batch.column(1).to_pylist(), [batch.column(k) for k in (3, 4)]
            rows, leaves = [], []
            bpe.trim()
            for k, edits in enumerate(edit_lists):
                own = tuple(x[k].values.to_numpy() for x in sums)
                wanted = [e for e in edits or [] if e is not None and e["start"] is not None]
                if not wanted:
                    rows.append((texts[k], before[k], 0, 0))
                    leaves.append(own)
                    continue
                tree = CountTree(bpe, texts[k], *own)
                for e in wanted:
                    tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "")
                rows.append((tree.text, tree.n_tokens, len(wanted), tree.recounted))
                leaves.append(tree.leaves())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r[0] for r in rows], pa.string()), *_tree_arrays([r[1] for r in rows], leaves), batch.column(2), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3))],
                names=[id_column, text_column, "n_tokens", "characters", "tokens", "n_tokens_before", "n_edits", "n_recounted"],
            )

    part = trees.select(id_column, text_column, "n_tokens", "characters", "tokens", F.col(edits_column).cast(EDITS).alias(edits_column))
    return part.mapInArrow(run, f"`{id_column}` {kind}, `{text_column}` string, {TREE}, n_tokens_before long, n_edits long, n_recounted long")


def edited_counts(trees: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", edits_column: str = "edits") -> DataFrame:
    """One row per row of trees: the id, n_tokens (before), n_edits, n_tokens_edited (after), n_recounted; see edited_trees()."""
    out = edited_trees(trees, tokenizer, id_column, text_column, edits_column)
    return out.select(id_column, F.col("n_tokens_before").alias("n_tokens"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "n_recounted")


def with_sample_edits(docs: DataFrame) -> DataFrame:
    """docs with three edits each, placed by a hash of doc_id: a replacement, an insertion and a deletion.

    Null texts have theirs at the start; rows of equal ids and lengths, and null ids, have equal edits; an empty table stays empty;
    a column edits is replaced, others are kept.
    """
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1)
    edit = lambda start, size, text: F.struct(start.alias("start"), (start + size).alias("end"), F.lit(text).alias("text"))
    return docs.withColumn("edits", F.array(edit(at(1), 7, "revised"), edit(at(2), 0, " it's 20% more,\n\n"), edit(at(3), 12, "")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = saved(count_trees(documents(spark, sf_dir), default_tokenizer()), "trees")
    return edited_counts(with_sample_edits(trees), default_tokenizer())
