"""Packing documents into sequences: vector best fit over residual tokens, documents and attention cost.

Texts become pieces of at most a sequence's tokens; shards of pieces are packed by best fit decreasing, and the emptiest
sequences of neighbouring shards are packed anew together, level by level, until one shard is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.bpe import groups
from threadloom.llm.common import documents, one_thread, saved, ship

#: The query's sequences, and the id that ends each document.
TOKENS, END_ID = 4096, 1
#: Pieces in a shard, shards that hand their emptiest sequences to one task of the next level, and how many each hands on.
SHARD, FAN_IN, HANDED = 20_000, 16, 64
#: A worker remembers the ids of so many new words before it forgets those it has not met since.
REMEMBERED = 600_000
#: Texts are encoded in groups of about so many bytes, so that a word of many texts is looked for once.
GROUP_BYTES = 1 << 22
#: Words that are encoded by one call.
TOGETHER = 256


class WordEncoder:
    """Ids of texts as bytes of 4 each, by a tokenizers file whose pre-tokens hold no white space.

    Words between white space are encoded once while they are remembered: neither normalisation nor merges look across white
    space, so a text's ids are those of its words, one after another.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        one_thread()
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t for _, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special and not t.normalized]
        if not special:
            raise ValueError("the tokenizer needs a special token, which separates words that are encoded together")
        self.mark, self.mark_id = special[-1].content, self.tokenizer.token_to_id(special[-1].content)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        """Make sure that the words are among the remembered ones."""
        young, old, new, odd = self.young, self.old, [], []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        texts = [w.decode() for w in new]
        if any(a in " ".join(texts) for a in self.added):  # words with special tokens go alone
            odd = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
            for k in odd:
                young[new[k]] = self.ids(texts[k])
            skip = set(odd)
            new, texts = [w for k, w in enumerate(new) if k not in skip], [t for k, t in enumerate(texts) if k not in skip]
        for a in range(0, len(new), 16 * TOGETHER):
            runs = [texts[b : b + TOGETHER] for b in range(a, min(a + 16 * TOGETHER, len(new)), TOGETHER)]
            b = a
            for run, found in zip(runs, self.tokenizer.encode_batch_fast([self.mark.join(r) for r in runs], add_special_tokens=False)):
                ids = np.array(found.ids, "<u4")
                ends = [*np.flatnonzero(ids == self.mark_id).tolist(), len(ids)]
                raw, at = ids.tobytes(), 0
                for w, end in zip(new[b : b + len(run)], ends, strict=True):
                    young[w] = raw[4 * at : 4 * end]
                    at = end + 1
                b += len(run)

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_batch(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text, 4 bytes little-endian each."""
        words = [t.split() for t in texts]  # bytes split at U+0020 and U+0009 to U+000D
        self.learn(set().union(*words))
        known = self.young.__getitem__
        for w in words:
            yield b"".join(map(known, w))
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}


_encoders: dict[str, WordEncoder] = {}


def _encoder(spec_file: str, key: str) -> WordEncoder:
    if key not in _encoders:
        _encoders.clear()
        with open(SparkFiles.get(spec_file), encoding="utf-8") as f:
            _encoders[key] = WordEncoder(f.read())
    return _encoders[key]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_pieces(docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True) -> DataFrame:
    """Rows (piece_key, doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and an end id, in pieces of at most `tokens`.

    Only documents of more tokens are cut, into full pieces and a rest. tokenizer: the path of a tokenizers file whose
    pre-tokens hold no white space, read on the driver and sent to the executors. piece_key tells rows apart, also of repeated
    documents. Null counts as an empty text, which is one piece of the end id; other columns are ignored; an empty table gives an
    empty result. A task holds a group of texts of about 4 MB or one longer text, with its words, and the words it remembers.
    """
    import os

    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    sc.addFile(tokenizer)
    name, key = os.path.basename(tokenizer), f"{sc.applicationId}:{tokenizer}"
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"piece_key long, `{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(name, key)
        next_key = TaskContext.get().partitionId() << 33
        for batch in batches:
            raw = pc.fill_null(batch.column(1).cast(pa.binary()), b"")
            for a, b in groups(pc.binary_length(raw).to_pylist(), GROUP_BYTES):
                owner, piece, start, length, crc, ids = [], [], [], [], [], []
                for row, found in enumerate(encoder.encode_batch(raw.slice(a, b - a).to_pylist()), a):
                    view = memoryview(found + end)
                    for k, at in enumerate(range(0, len(view), 4 * tokens)):
                        part = view[at : at + 4 * tokens]
                        owner.append(row)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(bytes(part))
                n = len(owner)
                columns = [pa.array(np.arange(next_key, next_key + n)), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                next_key += n
                names = ["piece_key", id_column, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    return docs.select(id_column, F.col(text_column).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> np.ndarray:
    """The bin of each item, items being rows of sizes; every bin holds at most the capacities in each column.

    Items come from large to small (by their largest share of a capacity, ties by their place). Of the open bins that can take
    an item in every column, it goes to the one with the least weighted residual norm after it, or for rule "dot" to the one
    whose residual after it has the least weighted dot product with the item; if there is none, a bin is opened.
    """
    n, dims = sizes.shape
    if n and (sizes > capacities).any():
        raise ValueError("an item exceeds a capacity")
    share = sizes / capacities
    order = np.argsort(-share.max(axis=1) if n else np.zeros(0), kind="stable")
    least = sizes.min(axis=0) if n else None
    out, opened, m = np.zeros(n, np.int64), 0, 0
    left, name = np.empty((dims, max(16, n)), np.int64), np.empty(max(16, n), np.int64)
    scale, w = capacities.astype(float), weights.astype(float)
    for k in order.tolist():
        size = sizes[k]
        fits = left[0, :m] >= size[0]
        for d in range(1, dims):
            fits &= left[d, :m] >= size[d]
        at = np.flatnonzero(fits)
        if len(at):
            after = (left[:, at] - size[:, None]) / scale[:, None]
            score = (w @ (after * after)) if rule == "norm" else ((w * share[k]) @ after)
            j = int(at[np.argmin(score)])
        else:
            j, m = m, m + 1
            left[:, j], name[j] = capacities, opened
            opened += 1
        out[k] = name[j]
        left[:, j] -= size
        if (left[:, j] < least).any():  # full: its place is taken by the last open bin
            m -= 1
            left[:, j], name[j] = left[:, m], name[m]
    return out


def _packer(level: int, last: bool, capacities: dict, weights: dict, rule: str):
    names = list(capacities)
    limits, w = np.array([capacities[c] for c in names], np.int64), np.array([weights.get(c, 1.0) for c in names])

    def run(table: pa.Table) -> pa.Table:
        sizes = np.stack([table.column(c).to_numpy() for c in names], axis=1).astype(np.int64)
        bins = best_fit(sizes, limits, w, rule)
        total = int(bins.max()) + 1
        fill = np.bincount(bins, weights=sizes[:, 0], minlength=total)
        handed = np.zeros(total, bool)
        if not last:
            handed[np.argsort(fill, kind="stable")[:HANDED]] = True
            handed &= fill < limits[0]
        order = np.lexsort((np.arange(len(bins)), bins))
        before = np.cumsum(sizes[order, 0]) - sizes[order, 0]
        first = np.r_[0, np.flatnonzero(np.diff(bins[order])) + 1]
        offset = np.empty(len(bins), np.int64)
        offset[order] = before - np.repeat(before[first], np.diff(np.r_[first, len(bins)]))
        shard = table.column("shard")[0].as_py()
        out = table.set_column(table.schema.get_field_index("sequence_id"), "sequence_id", pa.array((level << 58) + (shard << 24) + bins))
        out = out.set_column(out.schema.get_field_index("offset"), "offset", pa.array(offset))
        return out.set_column(out.schema.get_field_index("handed"), "handed", pa.array(handed[bins]))

    return run


def pack(pieces: DataFrame, capacities: dict[str, int], weights: dict[str, float] | None = None, rule: str = "norm", key: str = "piece_key") -> DataFrame:
    """pieces with sequence_id and offset: sequences hold at most the capacities of each named column, in as few as best fit finds.

    capacities: the limit of each column's sum within a sequence; the first column is the one that offsets count. weights: of
    the columns in the choice of a sequence (best_fit()); 1 unless named. key: a column that differs between rows; it deals
    them to shards of about SHARD. A shard hands on at most HANDED sequences, so tasks stay bounded at every level, whose
    number grows as the logarithm of the rows. Rows are never changed or dropped; a row above a capacity is an error; an
    empty table gives an empty result. Columns named shard or handed cannot be passed on.
    """
    ship(pieces.sparkSession)
    pieces = saved(pieces, "pieces")
    rows = pieces.count()
    shards = max(1, -(-rows // SHARD))
    schema = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "shard": F.lit(0).cast("long"), "handed": F.lit(False)}).schema
    todo = pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "shard": F.pmod(F.xxhash64(key), F.lit(shards)), "handed": F.lit(False)})
    done, level = None, 0
    while True:
        last = shards == 1
        packed = saved(todo.groupBy("shard").applyInArrow(_packer(level, last, capacities, weights or {}, rule), schema), f"packed-{level}")
        final = packed.where(~F.col("handed"))
        done = final if done is None else done.unionByName(final)
        if last:
            return done.drop("shard", "handed")
        shards, level = -(-shards // FAN_IN), level + 1
        todo = packed.where("handed").withColumn("shard", F.floor(F.col("shard") / FAN_IN).cast("long"))


def pack_documents(
    docs: DataFrame, tokenizer: str, tokens: int = TOKENS, end_id: int = END_ID, most_documents: int | None = None, most_attention: int | None = None,
    weights: dict[str, float] | None = None, rule: str = "norm", id_column: str = "doc_id", text_column: str = "text", with_ids: bool = True,
) -> DataFrame:
    """Pieces of documents as encode_pieces() gives them, each with its sequence_id and offset.

    A sequence holds at most `tokens` tokens, most_documents pieces and an attention cost of most_attention, where a piece
    costs the square of its length, as tokens see their own document only; a limit left out binds nothing that the
    tokens do not. most_attention below the square of `tokens` cannot hold full pieces and is an error where one comes.
    Nulls, repeated rows, empty tables and other columns: as encode_pieces().
    """
    pieces = encode_pieces(docs, tokenizer, tokens, end_id, id_column, text_column, with_ids)
    pieces = pieces.withColumns({"documents": F.lit(1).cast("long"), "attention": F.col("length") * F.col("length")})
    capacities = {"length": tokens, "documents": most_documents or tokens, "attention": most_attention or tokens * tokens}
    return pack(pieces, capacities, weights or {"documents": 0.01, "attention": 0.01}, rule).drop("documents", "attention", "piece_key")


def sequences(packed: DataFrame) -> DataFrame:
    """Rows (sequence_id, ids, lengths): the ids of pack_documents(with_ids=True) as sequences, with the lengths of their pieces in order.

    A sequence is bounded by its capacity, so gathering it is. Empty tables give an empty result.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return out.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), F.expr("transform(p, x -> x.length)").alias("lengths"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer(), with_ids=False)
