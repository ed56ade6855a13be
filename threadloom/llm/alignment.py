"""Aligning two tokenizers: packed bitsets of token ends over bytes give shared cuts, token ranges by rank, and links.

A byte-level BPE (A) and a sentencepiece BPE with byte fallback (B) are laid over the same bytes. Texts fall into units at
places that neither tokenizer looks across, so a block of documents aligns each of its distinct units once. The corpus-wide counts
of linked id pairs are added up over blocks and joined back to the pairs of a block, never to those of a document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.bpe import byte_characters, groups
from threadloom.llm.common import documents, one_thread, saved, ship

#: A unit is white space and what follows, up to a space or a line break behind something else than white space.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")
# The same where there is no other white space.
_PLAIN, _OTHER_SPACE = re.compile(r"[ \n]*[^ \n]+|[ \n]+"), re.compile(r"[^\S \n]")
#: A block of documents ends once it has so many units, or what it holds takes about so many bytes.
BLOCK_UNITS, BLOCK_BYTES = 1 << 22, 1 << 26
#: What a distinct unit takes besides its characters, groups and links.
_UNIT_BYTES = 200
#: Units that are encoded as one string, and such strings that are aligned at once.
TOGETHER, AT_ONCE = 64, 256
#: Stands before units that are encoded, as no unit but a text's first one starts a text.
_LEAD = " ."
_U = np.uint64


def units(text: str) -> list[str]:
    """The units of a text that is led by a space, one after another."""
    return (UNIT if _OTHER_SPACE.search(text) else _PLAIN).findall(text)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Bits:
    """A packed bitset over byte places 1 to n with rank and select."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, places: np.ndarray, n: int) -> Bits:
        flags = np.zeros(-(-(n + 1) // 64) * 64, bool)
        flags[places] = True
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def __and__(self, other: Bits) -> Bits:
        return Bits(self.words & other.words)

    def __or__(self, other: Bits) -> Bits:
        return Bits(self.words | other.words)

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many marked places are at or before each place."""
        word, bit = places >> 6, (places & 63).astype(_U)
        return self.before[word] + np.bitwise_count(self.words[word] & (~_U(0) >> (_U(63) - bit)))

    def select(self) -> np.ndarray:
        """All marked places, in order."""
        return np.flatnonzero(np.unpackbits(self.words.view(np.uint8), bitorder="little"))


class Aligner:
    """Both tokenizers, and the alignment of runs of units."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        one_thread()
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        chars = byte_characters()
        added = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        of_id = {i: bytes(chars[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if i not in added} | added
        self.size_a = np.array([len(of_id.get(i, b"")) for i in range(max(of_id) + 1)])
        self.b = SentencePieceProcessor(model_file=path_b)
        self.bytes_b, self.size_b = [], None
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:-1], 16)]))
            else:
                self.bytes_b.append(piece.replace("▁", " ").encode())
            if not self.b.is_control(i) and re.search("[^▁\\s][▁\n]", piece):
                raise ValueError(f"piece {i} holds the end of a unit")
        self.size_b = np.array([len(x) for x in self.bytes_b])
        self.code = len(self.bytes_b)  # of a pair: a * code + b
        # Ids as they stand within a group, and at the end of its side.
        self.inner_a, self.last_a = self._written(len(self.size_a), b","), self._written(len(self.size_a), b"|")
        self.inner_b, self.last_b = self._written(len(self.size_b), b","), self._written(len(self.size_b), b";")

    @staticmethod
    def _written(n: int, end: bytes) -> np.ndarray:
        return np.array([b"%d%s" % (i, end) for i in range(n)], dtype=object)

    def align(self, units: list[str], together: int = TOGETHER) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Rows (n_a, n_b, n_groups, n_links) and groups of each unit, and the codes of all their links, unit after unit.

        Units are encoded `together` as one string; strings that B does not give back are taken unit by unit, and a unit that
        it does not give back has zeros. The groups of a unit end in a semicolon.
        """
        if not units:
            return np.zeros((0, 4), np.int64), [], np.zeros(0, np.int64)
        runs = [units[k : k + together] for k in range(0, len(units), together)]
        strings = [_LEAD + "".join(r) for r in runs]
        ids_a = [e.ids for e in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        ids_b = self.b.encode([s[1:] for s in strings], num_threads=1)  # which puts the space before
        raw = [s.encode() for s in strings]
        good = [b"".join(map(self.bytes_b.__getitem__, b)) == r for b, r in zip(ids_b, raw)]
        if all(good):
            return self._aligned(runs, ids_a, ids_b, sum(map(len, raw)))
        if len(units) == 1:
            return np.zeros((1, 4), np.int64), [b""], np.zeros(0, np.int64)
        parts = [self.align(r, together if g else 1) if len(runs) > 1 else self.align(r[k : k + 1], 1) for r, g in zip(runs, good) for k in range(1 if len(runs) > 1 else len(r))]
        return np.concatenate([x[0] for x in parts]), [t for x in parts for t in x[1]], np.concatenate([x[2] for x in parts])

    def _aligned(self, runs, ids_a, ids_b, n: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        ends_a, ends_b = Bits.of(np.cumsum(self.size_a[a]), n), Bits.of(np.cumsum(self.size_b[b]), n)
        cuts = (ends_a & ends_b).select()
        # Tokens up to each cut; a group is what lies between two cuts.
        cut_a, cut_b = ends_a.rank(cuts), ends_b.rank(cuts)
        # Between two neighbouring ends, of whichever side, one token of each lies over the bytes: a link.
        links = (ends_a | ends_b).select()
        codes = a[ends_a.rank(links - 1)] * self.code + b[ends_b.rank(links - 1)]
        # Written out, each group's A ids stand before its B ids.
        per_a, per_b = np.diff(cut_a, prepend=0), np.diff(cut_b, prepend=0)
        written = np.empty(len(a) + len(b), dtype=object)
        text_a, text_b = self.inner_a[a], self.inner_b[b]
        text_a[cut_a - 1], text_b[cut_b - 1] = self.last_a[a[cut_a - 1]], self.last_b[b[cut_b - 1]]
        written[np.arange(len(a)) + np.repeat(cut_b - per_b, per_a)] = text_a
        written[np.arange(len(b)) + np.repeat(cut_a, per_b)] = text_b
        # Where each unit starts and ends; every run is led by _LEAD.
        ends = np.cumsum([len(u.encode()) for r in runs for u in (_LEAD, *r)])
        lead = np.cumsum([0, *[len(r) + 1 for r in runs[:-1]]])
        unit = np.delete(np.arange(len(ends)), lead)
        since, to = np.searchsorted(cuts, ends[unit - 1]), np.searchsorted(cuts, ends[unit])
        if (cuts[to] != ends[unit]).any() or (cuts[since] != ends[unit - 1]).any():
            raise ValueError("a token crosses the end of a unit")
        link_since, link_to = np.searchsorted(links, ends[unit - 1]) + 1, np.searchsorted(links, ends[unit]) + 1
        counts = np.stack([cut_a[to] - cut_a[since], cut_b[to] - cut_b[since], to - since, link_to - link_since], axis=1)
        at, before = written.tolist(), cut_a + cut_b
        texts = [b"".join(at[s:t]) for s, t in zip(before[since].tolist(), before[to].tolist())]
        use = np.repeat(link_since - (np.cumsum(counts[:, 3]) - counts[:, 3]), counts[:, 3]) + np.arange(int(counts[:, 3].sum()))
        return counts, texts, codes[use]


class Block:
    """Distinct units of a run of documents, and the documents as the units they are made of."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.at, self.texts, self.total = aligner, {}, [], 0
        # Codes of natural vocabularies fit 4 bytes.
        self.kind = np.uint32 if len(aligner.size_a) * aligner.code < 1 << 32 else np.int64
        self.counts, self.codes, self.seen, self.bytes = np.zeros((0, 4), np.int64), np.zeros(0, self.kind), [], 0

    def _keep(self, counts: np.ndarray, texts: list[bytes], codes: np.ndarray, characters: int = 0) -> None:
        self.texts += texts
        self.counts, self.codes = np.concatenate([self.counts, counts]), np.concatenate([self.codes, codes.astype(self.kind)])
        self.bytes += _UNIT_BYTES * len(texts) + sum(map(len, texts)) + self.codes.itemsize * len(codes) + characters

    def learn(self, wanted: Iterable[str]) -> None:
        new = [u for u in wanted if u not in self.at]
        # White space at a text's end goes alone: it would run into what follows.
        for part, together in (([u for u in new if not u[-1].isspace()], TOGETHER), ([u for u in new if u[-1].isspace()], 1)):
            for k in range(0, len(part), TOGETHER * AT_ONCE):
                some = part[k : k + TOGETHER * AT_ONCE]
                self.at.update(zip(some, range(len(self.texts), len(self.texts) + len(some))))
                self._keep(*self.aligner.align(some, together), sum(map(len, some)))

    def add(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Rows (n_a, n_b, n_groups, n_links) and groups_sha256 of each text, the places of all texts' units, and how many each has."""
        parts = [units(" " + t) if t else [] for t in texts]
        self.learn(dict.fromkeys(chain.from_iterable(parts)))
        at = [list(map(self.at.__getitem__, p)) for p in parts]
        odd = np.flatnonzero(self.counts[:, 3] == 0)
        if len(odd):  # a text with a unit that does not come back is judged as a whole
            odd = set(odd.tolist())
            for k, text in enumerate(texts):
                if not odd.isdisjoint(at[k]):
                    self.at.pop(" " + text, None)
                    counts, written, codes = self.aligner.align([" " + text], 1)
                    at[k] = [len(self.texts)] if counts[0, 3] else []
                    self._keep(counts, written, codes)
        sizes = np.array([len(x) for x in at], np.int64)
        flat, owner = np.fromiter(chain.from_iterable(at), np.int64, int(sizes.sum())), np.repeat(np.arange(len(texts)), sizes)
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[flat], axis=0)])
        to = np.cumsum(sizes)
        groups = [hashlib.sha256(b"".join(map(self.texts.__getitem__, x))[:-1]).hexdigest() if x else "" for x in at]
        # Each document counts once for a pair: first its distinct units, then their distinct pairs.
        once = _distinct(owner << 32 | flat)
        unit, links = once & 0xFFFFFFFF, self.counts[:, 3]
        ends, each = np.cumsum(links), links[unit]
        use = np.repeat(ends[unit] - each - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        self.seen.append(_distinct(np.repeat(once >> 32, each) << 40 | self.codes[use].astype(np.int64)) & ((1 << 40) - 1))
        self.total, self.bytes = self.total + len(flat), self.bytes + self.seen[-1].nbytes
        return sums[to] - sums[to - sizes], groups, flat, sizes

    def full(self) -> bool:
        return self.total >= BLOCK_UNITS or self.bytes >= BLOCK_BYTES

    def closed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct codes, the documents of each, and the units' links: numbers of links, and places among the codes."""
        seen = np.sort(np.concatenate([np.zeros(0, np.int64), *self.seen]))
        first = np.flatnonzero(np.r_[True, seen[1:] != seen[:-1]]) if len(seen) else np.zeros(0, np.int64)
        codes, docs = seen[first], np.diff(np.r_[first, len(seen)])
        # Links of units whose texts do not come back may lack a code; no document reads them.
        return codes, docs, self.counts[:, 3], np.minimum(np.searchsorted(codes.astype(self.kind), self.codes), max(len(codes) - 1, 0))


_aligners: dict[str, Aligner] = {}


def _aligner(name_a: str, name_b: str, key: str) -> Aligner:
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(SparkFiles.get(name_a), SparkFiles.get(name_b))
    return _aligners[key]


_SMALL = 1 << 16


def aligned_blocks(docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str) -> DataFrame:
    """A row for each document with its own counts and units, and one for each block (pairs not null) with its pairs and units.

    Units are packed as places in the block's list of them: the first 65,536 in 2 bytes each, later ones in 4.
    """
    ship(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    for path in (path_a, path_b):
        sc.addFile(path)
    key, names = f"{sc.applicationId}:{path_a}:{path_b}", (os.path.basename(path_a), os.path.basename(path_b))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"block long, `{id_column}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, low binary, high binary, pairs array<long>, docs array<long>, sizes binary, links binary"

    def run(batches):
        aligner, id_type = _aligner(*names, key), None
        number, block = TaskContext.get().partitionId() << 33, Block(aligner)

        def rows(ids, added, head=None):
            counts, groups, flat, sizes = added
            n, edges = len(ids), np.cumsum(sizes)[:-1]
            packed = [[x[x < _SMALL].astype("<u2").tobytes(), x[x >= _SMALL].astype("<u4").tobytes()] for x in np.split(flat, edges)]
            columns = [pa.array([number] * n, pa.int64()), ids, *[pa.array(c, pa.int64()) for c in counts.T], pa.array(groups, pa.string())]
            columns += [pa.array([x[k] for x in packed], pa.binary()) for k in (0, 1)]
            if head:
                codes, docs, links, places = head
                columns += [pa.array([x], pa.list_(pa.int64())) for x in (codes, docs)] + [pa.array([x.astype("<u4").tobytes()], pa.binary()) for x in (links, places)]
            else:
                columns += [pa.nulls(n, pa.list_(pa.int64()))] * 2 + [pa.nulls(n, pa.binary())] * 2
            return pa.RecordBatch.from_arrays(columns, names=["block", id_column, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "low", "high", "pairs", "docs", "sizes", "links"])

        nothing = (np.zeros((1, 4), np.int64), [""], np.zeros(0, np.int64), np.zeros(1, np.int64))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            id_type = ids.type
            for a, b in groups(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                yield rows(ids.slice(a, b - a), block.add([t or "" for t in texts.slice(a, b - a).to_pylist()]))
                if block.full():
                    yield rows(pa.nulls(1, id_type), nothing, block.closed())
                    number, block = number + 1, Block(aligner)
        if block.texts:
            yield rows(pa.nulls(1, id_type), nothing, block.closed())

    return docs.select(id_column, F.col(text_column).cast("string").alias("text")).mapInArrow(run, schema)


def pair_counts(blocks: DataFrame, code: int) -> DataFrame:
    """Rows (pair, docs, best): the documents that hold a pair, and whether no pair of its A id is held by more."""
    pairs = blocks.where("pairs is not null").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("docs"))
    pairs = saved(pairs, "op13-pairs").withColumn("a", F.expr(f"pair div {code}"))
    most = pairs.groupBy("a").agg(F.max("docs").alias("most"))  # as many rows as A has ids
    return pairs.join(most, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def _totals(id_column: str, id_type: pa.DataType):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heads = left.filter(pc.is_valid(left.column("sizes")))
        rows = left.filter(pc.is_null(left.column("sizes")))
        n = rows.num_rows
        total, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if heads.num_rows and right.num_rows:
            order = np.argsort(right.column("pair").to_numpy())
            count, top = right.column("docs").to_numpy()[order], right.column("best").to_numpy().astype(np.int64)[order]
            sizes, links = (np.frombuffer(heads.column(c)[0].as_py(), "<u4") for c in ("sizes", "links"))
            ends = np.cumsum(sizes, dtype=np.int64)
            unit_total, unit_best = (np.concatenate([np.zeros(1, np.int64), np.cumsum(x[links], dtype=np.int64)]) for x in (count, top))
            unit_total, unit_best = (x[ends] - x[ends - sizes] for x in (unit_total, unit_best))
            for c, form in (("low", "<u2"), ("high", "<u4")):
                column = rows.column(c)
                each = pc.binary_length(column).to_numpy() // int(form[-1])
                at = np.frombuffer(b"".join(column.to_pylist()), form)
                to = np.cumsum(each)
                for out, unit in ((total, unit_total), (best, unit_best)):
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(unit[at], dtype=np.int64)])
                    out += sums[to] - sums[to - each]
        columns = {id_column: rows.column(id_column).cast(id_type), **{c: rows.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")}}
        return pa.table(columns | {"n_best": total * 0 + best, "count_sum": total, "groups_sha256": rows.column("groups_sha256")})

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of its alignment.

    path_a: a tokenizers file of byte-level BPE, applied to a space and the text; path_b: a sentencepiece model with byte fallback,
    applied to the text, which puts the space before. Strings of special tokens are plain text. A group lies between two byte
    places where both sides' tokens end; a link is a pair of tokens that share bytes; a pair of ids counts as many
    documents as hold it linked. n_best are the links whose pair has the highest count of its A id, ties included.

    Null and empty texts, and texts that B does not give back byte for byte (as with U+2581), have no tokens: zeros, and an empty
    groups_sha256. Repeated rows are documents of their own; other columns are ignored; an empty table gives an empty result. A
    task holds one block (BLOCK_UNITS units, about BLOCK_BYTES of distinct ones) and a group of texts of about 1 MB or one longer text.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from sentencepiece import SentencePieceProcessor

    code = SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = saved(aligned_blocks(docs, path_a, path_b, id_column, text_column), "op13-blocks")
    held = blocks.where("pairs is not null").select("block", F.explode("pairs").alias("pair"))
    counts = held.join(pair_counts(blocks, code), "pair")
    counts = saved(counts.select("block", "pair", "docs", "best"), "op13-counts")
    field = docs.schema[id_column]
    schema = f"`{id_column}` {field.dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    left = blocks.drop("pairs", "docs").groupBy("block")
    return left.cogroup(counts.groupBy("block")).applyInArrow(_totals(id_column, to_arrow_type(field.dataType)), schema)


def linked_pairs(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (a, b, docs, best): every linked pair of ids, the documents that hold it, and whether it is its A id's most frequent one.

    Texts, nulls and tokenizers as in align_documents().
    """
    from sentencepiece import SentencePieceProcessor

    code = SentencePieceProcessor(model_file=path_b).get_piece_size()
    blocks = saved(aligned_blocks(docs, path_a, path_b, id_column, text_column), "op13-blocks")
    return pair_counts(blocks, code).select(F.expr(f"cast(pair div {code} as int)").alias("a"), F.expr(f"cast(pair % {code} as int)").alias("b"), "docs", "best")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(documents(spark, sf_dir), *default_tokenizers())
