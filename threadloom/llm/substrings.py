"""Repeated passages: suffix automata of reference shards give matching statistics, and repeated windows are removed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, saved, ship
from threadloom.llm.text import SEEDS, Words, grams, mix, pieces

#: Words in a window, and in the anchor by which equal windows meet.
WINDOW, ANCHOR = 13, 5
#: Anchors of a task are compared among themselves in blocks of so many.
BLOCK = 1_000_000
#: Anchors are dealt by so many of their first bits; a block's anchors of one such bucket travel as one row.
BUCKET_BITS = 16
#: Anchors that are known to be shared and stand for no others travel in rows of so many.
PASSED = 4_000
#: Results of shards are handed on together, in batches of so many segments.
BATCH = 4_000
#: Anchors with more distinct segments are matched window by window.
HEAVY = 2_000

_U = np.uint64


class SuffixAutomaton:
    """The suffix automaton of several word sequences; a state knows the least document that has its strings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, like: int | None = None) -> int:
        self.next.append({} if like is None else dict(self.next[like]))
        self.link.append(-1 if like is None else self.link[like])
        self.least.append(None)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, word) -> int:
        """A state for the strings of q that are no longer than one word after p."""
        nxt, link = self.next, self.link
        clone = self._state(self.length[p] + 1, q)
        self.least[clone] = self.least[q]
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, words: list, document: int) -> list[int]:
        """Take in a sequence of a document; sequences may come in any order.

        Returns the state of each prefix. It stays the state of the longest match at that word whatever is added later, as
        splits take a state's shorter strings away and leave it its longest one.
        """
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last, path = 0, []
        for word in words:
            q = nxt[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, word)
                if least[last] is None or document < least[last]:
                    least[last] = document
            else:
                new, p = len(length), last
                nxt.append({})
                length.append(length[last] + 1)
                least.append(document)
                link.append(0)
                while p >= 0:
                    to = nxt[p]
                    q = to.get(word)
                    if q is not None:
                        link[new] = q if length[q] == length[p] + 1 else self._split(p, q, word)
                        break
                    to[word] = new
                    p = link[p]
                last = new
            path.append(last)
        return path

    def close(self, shortest: int = 1) -> None:
        """Hand every state's least document to the suffixes of its strings that have so many words or more."""
        least, link, length = self.least, self.link, self.length
        for s in sorted((s for s in range(1, len(least)) if length[link[s]] >= shortest), key=length.__getitem__, reverse=True):
            p = link[s]
            if least[s] is not None and (least[p] is None or least[s] < least[p]):
                least[p] = least[s]

    def matches(self, words: list) -> Iterator[tuple[int, int]]:
        """Matching statistics: at each word the state and length of the longest match that ends there."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        for word in words:
            while state and word not in nxt[state]:
                state = link[state]
                matched = length[state]
            to = nxt[state].get(word)
            if to is None:
                state = matched = 0
            else:
                state, matched = to, matched + 1
            yield state, matched

    def first_documents(self, words: list, size: int) -> list:
        """For each window of size words, the least document that has it, or None."""
        return self._least_of((state if matched >= size else 0 for state, matched in self.matches(words)), size)

    def first_documents_held(self, path: list[int], size: int) -> list:
        """The same for a sequence that was taken in, from the states that add() gave for it: its matches are its prefixes."""
        return self._least_of(path, size)

    def _least_of(self, states, size: int) -> list:
        link, length, least, out = self.link, self.length, self.least, []
        for state in islice(states, size - 1, None):
            while state and length[link[state]] >= size:
                state = link[state]
            out.append(least[state])
        return out


def owners(words: Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first window, last window (word indices) and anchor hash of each segment.

    A window's owner is its anchor, a run of words, with the least hash (the first on ties), so that equal windows have
    equal owners. A segment is a run of windows with one owner: on average every fifth window starts one.
    """
    h = words.hashes
    n = len(h) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(_U)
    g = grams(h, anchor)
    rank = mix(g ^ _U(0x5851F42D4C957F2D))
    at = _least_places(rank, window - anchor + 1)
    text = np.repeat(np.arange(len(words)), np.diff(words.first))[:n]
    fine = np.arange(n) + window <= words.first[text + 1]
    starts = fine.copy()
    starts[1:] &= (at[1:] != at[:-1]) | ~fine[:-1] | (text[1:] != text[:-1])
    ends = fine.copy()
    ends[:-1] &= starts[1:] | ~fine[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    return text[first], first, last, g[at[first]]


def _least_places(rank: np.ndarray, width: int) -> np.ndarray:
    """The place of the least value (the first on ties) of each run of width values: runs twice as long from pairs of runs."""
    best, at, span = rank, np.arange(len(rank)), 1
    while span < width:
        step = min(span, width - span)
        less = best[step:] < best[:-step]
        best, at = np.minimum(best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        span += step
    return at


def shared_anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(doc_id, anchor) for the anchors of each document that another document has too.

    A task first compares the anchors of its own documents. One document of each anchor in the block meets the other tasks',
    packed with the rest of its bucket; the other documents of an anchor, which is then known to be shared, pass through.
    """
    names, kind = ["bucket", "anchors", "docs", "known"], "bucket int, anchors binary, docs binary, known binary"

    def rows(anchors: list, ids: list):
        a, d = np.concatenate(anchors), np.concatenate(ids)
        order = np.argsort(a)
        a, d = a[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        starts = np.flatnonzero(new)
        several = np.repeat(np.minimum.reduceat(d, starts) != np.maximum.reduceat(d, starts), np.diff(np.append(starts, len(a))))
        # Of an anchor of one document one row is enough; only the others need to be in the order of documents.
        many = np.flatnonzero(several)
        many = many[np.lexsort((d[many], a[many]))]
        place = np.flatnonzero(new | several)
        place[several[place]] = many
        a, d = a[place], d[place]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        a, d = a[new], d[new]
        first = np.ones(len(a), bool)
        first[1:] = a[1:] != a[:-1]
        known = ~first
        known[:-1] |= ~first[1:]
        passed = np.flatnonzero(~first)
        for k in range(0, len(passed), PASSED):
            at = passed[k : k + PASSED]
            yield packed(-1 - mix(a[at[:1]]).view(np.int64) % (1 << 30), np.array([0, len(at)]), a[at], d[at], known[at])
        a, d, known = a[first], d[first], known[first]
        bucket = (a >> _U(64 - BUCKET_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[: len(a)])
        for k in range(0, len(starts), 10_000):
            cuts = np.append(starts, len(a))[k : k + 10_001]
            at = slice(cuts[0], cuts[-1])
            yield packed(bucket[cuts[:-1]], cuts - cuts[0], a[at], d[at], known[at])

    def packed(bucket, cuts, a, d, known):
        columns = [pa.array(bucket.astype(np.int32))]
        for x in (a, d, known):
            offsets = pa.py_buffer((cuts * x.itemsize).astype(np.int32))
            columns.append(pa.Array.from_buffers(pa.binary(), len(bucket), [None, offsets, pa.py_buffer(np.ascontiguousarray(x))]))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def unpacked(column, dtype):
        """The values of all rows, one after another, and how many each has."""
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(dtype), np.diff(offsets) // np.dtype(dtype).itemsize

    def emit(batches):
        anchors, ids, held = [], [], 0
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for a, b, words in pieces(batch.column(1), False):
                text, _, _, key = owners(words, window, anchor)
                anchors.append(key)
                ids.append(doc[a:b][text])
                held += len(key)
                if held >= BLOCK:
                    yield from rows(anchors, ids)
                    anchors, ids, held = [], [], 0
        if anchors:
            yield from rows(anchors, ids)

    def meet(batches):
        """Rows sorted by bucket; those of the last bucket wait for the next batch."""
        rest = None
        for batch in _and_none(batches):
            if batch is not None and len(batch):
                a, sizes = unpacked(batch.column(1), np.uint64)
                bucket = np.repeat(batch.column(0).to_numpy(), sizes)
                part = [bucket, a, unpacked(batch.column(2), np.int64)[0], unpacked(batch.column(3), bool)[0]]
                if bucket[0] < 0:
                    through = bucket < 0
                    yield shared_rows(part[1][through], part[2][through])
                    part = [x[~through] for x in part]
                rest = part if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, part)]
            if rest is None or not len(rest[0]):
                continue
            cut = len(rest[0]) if batch is None else int(np.searchsorted(rest[0], rest[0][-1]))
            if cut == 0:
                continue
            _, a, d, known = (x[:cut] for x in rest)
            rest = [x[cut:] for x in rest]
            order = np.argsort(a)
            a, d, known = a[order], d[order], known[order]
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            sizes = np.diff(np.append(starts, len(a)))
            shared = np.logical_or.reduceat(known, starts) | (np.maximum.reduceat(d, starts) != np.minimum.reduceat(d, starts))
            fine = np.repeat(shared, sizes)
            yield shared_rows(a[fine], d[fine])

    def shared_rows(a, d):
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(a.view(np.int64))], names=["doc_id", "anchor"])

    found = docs.select("doc_id", "text").mapInArrow(emit, kind)
    found = found.repartition("bucket").sortWithinPartitions("bucket")
    return found.mapInArrow(meet, "doc_id long, anchor long")


def _and_none(batches):
    yield from batches
    yield None


def segments(docs: DataFrame, anchors: DataFrame, window: int, anchor: int) -> DataFrame:
    """Two kinds of rows of the segments at shared anchors, in one table.

    A place: doc_id, text_hash (with doc_id it names the row), start (its first window), segment and other (two independent hashes
    of the words, 128 bits, by which places meet their references). A reference, once for a task: segment, other, anchor, words
    (joined by spaces), least (doc_id in this task).
    """
    mine = anchors.groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))  # no more than the document's words
    rows = docs.join(mine, "doc_id").select("doc_id", F.xxhash64("text").alias("text_hash"), "text", "anchors")

    def run(batches):
        seen: dict[tuple, list] = {}
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            for a, b, words in pieces(batch.column(2), False):
                text, first, last, key = owners(words, window, anchor)
                part = lists.slice(a, b - a)
                wanted = part.flatten().to_numpy().view(_U)
                # An anchor is looked up together with its text, by one search over all.
                of = np.repeat(np.arange(b - a), part.value_lengths().to_numpy())
                table = np.sort(mix(wanted) ^ mix(of.astype(_U) + _U(1)))
                probe = mix(key) ^ mix(text.astype(_U) + _U(1))
                at = np.minimum(np.searchsorted(table, probe), len(table) - 1)
                fine = np.flatnonzero(table[at] == probe)
                text, first, last, key = text[fine], first[fine], last[fine], key[fine]
                length = last - first + window
                code, other = _run_hash(words.hashes, first, length), _run_hash(words.hashed(SEEDS[1]), first, length)
                doc = ids[a:b][text]
                raw = words.data.tobytes()
                begin, end = words.starts[first].tolist(), words.ends[first + length - 1].tolist()
                for c, d, i, j, x in zip(zip(code.tolist(), other.tolist()), doc.tolist(), begin, end, key.view(np.int64).tolist()):
                    if c not in seen:
                        seen[c] = [d, x, b" ".join(raw[i:j].split())]  # splits at the same bytes as Words
                    elif d < seen[c][0]:
                        seen[c][0] = d
                n = len(code)
                yield _segment_rows(doc, texts[a:b][text], first - words.first[text], code, other, n, None)
                if len(seen) > 100_000:
                    yield _segment_rows(None, None, None, None, None, 0, seen)
                    seen = {}
        if seen:
            yield _segment_rows(None, None, None, None, None, 0, seen)

    return rows.mapInArrow(run, "doc_id long, text_hash long, start int, segment long, other long, anchor long, words binary, least long")


def _run_hash(h: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each run of words, from the words' hashes."""
    code, least = length.astype(_U), int(length.min(initial=1 << 30))
    for k in range(int(length.max(initial=0))):
        more = slice(None) if k < least else np.flatnonzero(k < length)
        code[more] = mix(code[more] * _U(0xC2B2AE3D27D4EB4F) + h[first[more] + k])
    return mix(code).view(np.int64)


def _segment_rows(doc, text_hash, start, code, other, n: int, seen: dict | None) -> pa.RecordBatch:
    names = ["doc_id", "text_hash", "start", "segment", "other", "anchor", "words", "least"]
    if seen is None:
        columns = [pa.array(doc), pa.array(text_hash), pa.array(start.astype(np.int32)), pa.array(code), pa.array(other), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64())]
    else:
        n, v = len(seen), list(seen.values())
        columns = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([c for c, _ in seen], pa.int64()), pa.array([c for _, c in seen], pa.int64()),
                   pa.array([x[1] for x in v], pa.int64()), pa.array([x[2] for x in v], pa.binary()), pa.array([x[0] for x in v], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def first_of_segments(references: DataFrame, window: int) -> DataFrame:
    """(segment, other, firsts): for each window of a segment the least document that has it.

    references: (segment, other, shard, words, least), distinct by segment, other and words. Rows are dealt and sorted by shard; a task
    builds one shard's automaton after another and reads each segment's matching statistics from the states it went through. Equal
    windows are of one shard, so that an automaton never needs two.
    """

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(k).to_pylist() for k in range(5)))

    def run(batches):
        out: list[tuple] = []
        for _, shard in groupby(rows_of(batches), key=lambda r: r[2]):
            automaton = SuffixAutomaton()
            held = [(segment, other, automaton.add(words.split(b" "), least)) for segment, other, _, words, least in shard]
            automaton.close(window)
            out += [(segment, other, automaton.first_documents_held(path, window)) for segment, other, path in held]
            if len(out) >= BATCH:
                yield found(out)
                out = []
        if out:
            yield found(out)

    def found(out):
        return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)), pa.array([r[2] for r in out], pa.list_(pa.int64()))], names=["segment", "other", "firsts"])

    rows = references.select("segment", "other", "shard", "words", "least").repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(run, "segment long, other long, firsts array<long>")


def heavy_windows(references: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """The windows of references as segments of their own, and where they lie in them: for anchors with very many segments."""

    def run(batches):
        for batch in batches:
            out = []
            for segment, other, words, least in zip(*(batch.column(k).to_pylist() for k in range(4))):
                w = words.split(b" ")
                out.extend((segment, other, k, b" ".join(w[k : k + window]), least) for k in range(len(w) - window + 1))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)), pa.array([r[2] for r in out], pa.int32()), pa.array([r[3] for r in out], pa.binary()), pa.array([r[4] for r in out], pa.int64())],
                names=["segment", "other", "at", "words", "least"],
            )

    rows = references.select("segment", "other", "words", "least").mapInArrow(run, "segment long, other long, at int, words binary, least long")
    places = saved(rows.withColumn("code", F.xxhash64("words", F.lit(WINDOW))).withColumn("code2", F.xxhash64(F.lit(WINDOW), F.reverse(F.hex("words")))), "windows")
    own = places.groupBy("code", "code2", "words").agg(F.min("least").alias("least"))
    return own.select(F.col("code").alias("segment"), F.col("code2").alias("other"), F.col("code").alias("shard"), "words", "least"), places.select("segment", "other", "at", "code", "code2")


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_hash, starts): the windows of each text that also start in a document with a smaller doc_id."""
    anchors = saved(shared_anchors(docs, window, anchor), "anchors")
    table = saved(segments(docs, anchors, window, anchor), "segments")
    references = table.filter("words IS NOT NULL").groupBy("segment", "other", "anchor", "words").agg(F.min("least").alias("least"))
    references = saved(references.withColumnRenamed("anchor", "shard"), "references")
    heavy = saved(references.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > HEAVY).select("shard"), "heavy")
    if heavy.isEmpty():
        firsts = saved(first_of_segments(references, window), "firsts")
    else:
        light = references.join(heavy, "shard", "left_anti")
        own, places = heavy_windows(references.join(heavy, "shard", "left_semi"), window)
        firsts = saved(first_of_segments(light.select("segment", "other", "shard", "words", "least").union(saved(own, "own-windows")), window), "firsts")
        single = firsts.select(F.col("segment").alias("code"), F.col("other").alias("code2"), F.col("firsts")[0].alias("first"))
        again = saved(places.join(single, ["code", "code2"]), "heavy-firsts").groupBy("segment", "other").agg(F.array_sort(F.collect_list(F.struct("at", "first"))).alias("f"))
        firsts = saved(firsts.union(again.select("segment", "other", F.col("f.first"))), "firsts")
    places = table.filter("words IS NULL").select("doc_id", "text_hash", "start", "segment", "other")
    found = places.join(firsts, ["segment", "other"]).select(
        "doc_id", "text_hash", F.expr("filter(transform(firsts, (f, k) -> CASE WHEN f < doc_id THEN start + k END), x -> x IS NOT NULL)").alias("starts")
    )
    found = saved(found.filter(F.size("starts") > 0), "repeats")
    return found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_set("starts")).alias("starts"))  # no more than the text's words


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (of removed words, ends exclusive), kept_text.

    A window is a run of words of one text. A word is removed if a window covers it whose words also start in a document
    with a smaller doc_id, as the input has them; maximal runs of such words are the spans. Kept words are joined
    by one space. Null texts count as empty. Rows of one doc_id do not remove each other's words; rows with a null doc_id
    lose nothing and are no reference. Empty tables give empty results; other columns are ignored.
    """
    ship(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    found = repeated_windows(plain.filter("doc_id IS NOT NULL"), window, anchor)
    rows = plain.withColumn("text_hash", F.xxhash64("text")).join(saved(found, "spans"), ["doc_id", "text_hash"], "left")

    def run(batches):
        for batch in batches:
            counts, removed, spans, kept = [], [], [], []
            for text, starts in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                w = text.split()  # bytes.split() splits at the same bytes as Words
                edges = _spans(starts, window)
                counts.append(len(w))
                removed.append(sum(y - x for x, y in edges))
                spans.append([{"start": x, "end": y} for x, y in edges])
                for x, y in reversed(edges):
                    del w[x:y]
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    return rows.select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")


def _spans(starts: list | None, window: int) -> list[tuple[int, int]]:
    """The union of the windows that start there, as maximal runs."""
    out: list[tuple[int, int]] = []
    for at in sorted(starts or ()):
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], at + window)
        else:
            out.append((at, at + window))
    return out


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
w AS (SELECT doc_id, len(w) AS n, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM t),
g AS (SELECT doc_id, i, w, n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM w),
f AS (SELECT doc_id, i, w, i + 12 <= n AND min(CASE WHEN i + 12 <= n THEN doc_id END) OVER (PARTITION BY g) < doc_id AS f FROM g),
c AS (SELECT doc_id, i, w, bool_or(f) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM f),
k AS (SELECT doc_id, count(*) FILTER (c) AS gone, string_agg(w, ' ' ORDER BY i) FILTER (NOT c) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
