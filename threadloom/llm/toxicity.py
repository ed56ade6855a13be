"""Toxicity: a noisy channel restores obfuscated words by Viterbi search, then learned word evidence scores the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import documents, saved, ship
from threadloom.llm.text import PIECE_BYTES, Words, column_bytes, grams, mix

#: At most so many labelled rows fit the word evidence, those with the least hash of their doc_id.
FIT_ROWS = 20_000
#: A text is predicted toxic from this score on.
THRESHOLD = 0.7
#: The score of a text without evidence, and the least evidence that a word may have.
BASE, LEAST = 0.01, 0.5
#: Standard deviations by which a word's share of toxic texts is lowered.
Z = 2.0
#: Lengths in bytes of the word beginnings that count as evidence beside whole words.
BEGINNINGS = (4, 5, 6)

#: What a character may stand for, besides nothing.
LEET = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou",
}
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
#: Logarithms of the channel's probabilities: of a character that stands for a letter, of one put in for nothing, of one
#: more or one less of a run, of a separator inside of a word, and of a word break there or between single letters.
SUBSTITUTED, DROPPED, REPEATED, JOINED, BROKEN = -1.0, -9.0, -0.5, -0.5, -3.0
#: Runs of up to so many symbols may stand for letters, each for its own; longer ones are decoration.
SHORT = 3
#: Single letters belong to one chain if no more than so many characters stand between them.
APART = 2

#: What stands at a place of the lattice: codes of bytes as they are, second letters of a pair and of longer runs, leetspeak
#: (each plus the byte), and decoration, a separator, a gap between single letters, a wider one, and a mask.
PAIR, RUN, AS_LEET = 256, 512, 768
DECORATION, SEPARATOR, GAP, WIDE, MASK = range(1024, 1029)
#: Emitted by a word break.
BREAK = 32

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_NOT_LETTER = ~_LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Symbols that end sentences or open brackets are no letters at a word's end.
_INSIDE = np.zeros(256, bool)
_INSIDE[[ord("!"), ord("(")]] = True
#: Bytes around a word that are no part of it.
_AROUND = np.zeros(256, bool)
_AROUND[[ord(c) for c in ".,;:!?\"'()[]{}<>"]] = True
#: Bytes of words in few classes: 0 for what is not a letter, 26 letters, 32 for continuation bytes, 8 for lead bytes.
_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = _CLASS[97:123] = np.arange(1, 27)
_CLASS[128:192] = 27 + np.arange(64) % 32
_CLASS[192:256] = 59 + np.arange(64) % 8
CLASSES = 67


def _channel() -> list[list[tuple[int, float]]]:
    """For each code what it may emit (a byte, a word break, or 0 for nothing), with the channel's logarithm."""
    leet = {ord(c): [*((ord(x), SUBSTITUTED) for x in to), (0, DROPPED)] for c, to in LEET.items()}
    out = [[(b, 0.0)] if b else [(0, 0.0)] for b in range(256)]
    out += [[(b, 0.0), (0, REPEATED)] for b in range(256)]
    out += [[(b, REPEATED), (0, REPEATED)] for b in range(256)]
    out += [leet.get(b, [(0, 0.0)]) for b in range(256)]
    out += [[(0, 0.0)], [(0, JOINED), (BREAK, BROKEN)], [(0, 0.0), (BREAK, BROKEN)], [(0, BROKEN), (BREAK, 0.0)], [(ord(x), SUBSTITUTED) for x in ALPHABET]]
    return out


OPTIONS = _channel()
_MOST = max(map(len, OPTIONS))
_EMIT, _COST = np.zeros((len(OPTIONS), _MOST), np.int64), np.full((len(OPTIONS), _MOST), -np.inf)
for _k, _o in enumerate(OPTIONS):
    _EMIT[_k, : len(_o)], _COST[_k, : len(_o)] = zip(*_o)
_WAYS = np.array([len(o) for o in OPTIONS])
#: Lattices are searched together by their length and by options at a place, with room for so many states each; those that
#: need more states, or are longer, are searched one by one.
_LENGTHS = (8, 12, 16, 24, 32, 64)
_ROOM = {2: 6, 7: 40, _MOST: 26 * 26 + 30}
_CELLS = 1 << 19


class CharacterModel:
    """Byte-class trigrams with interpolated lower orders; its size does not depend on the corpus."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
        two, k = three.sum(2), 5.0
        one = two.sum(1)
        p1 = (three.sum((0, 1)) + 1) / (three.sum() + CLASSES)
        p2 = (two + k * p1) / (one[:, None] + k)
        self.table = np.log((three + k * p2[None, :, :]) / (two[:, :, None] + k))
        self.flat = self.table.ravel()
        self.log = None

    def restore(self, codes: list[int]) -> bytes:
        """The likeliest reading of one lattice, exactly: the best path to each pair of last byte classes, place by place."""
        if self.log is None:
            self.log = self.table.tolist()
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for code in codes:
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for byte, cost in OPTIONS[code]:
                    z = int(_CLASS[byte])
                    key, s = ((b, z), score + cost + self.log[a][b][z]) if byte else ((a, b), score + cost)
                    if key not in after or after[key][0] < s:
                        after[key] = (s, (byte, path) if byte else path)
            states = after
        _, path = max(((s + self.log[a][b][0], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        out = bytearray()
        while path:
            out.append(path[0])
            path = path[1]
        return bytes(reversed(out))

    def restored(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The likeliest readings of many lattices (codes, one after another): their bytes and n + 1 offsets."""
        n = len(bounds) - 1
        size = np.diff(bounds)
        ways = np.maximum.reduceat(_WAYS[codes], bounds[:-1]) if n else size  # no lattice is empty
        out: list[bytes | None] = [None] * n
        alone = size > _LENGTHS[-1]
        low = 0
        for high in _LENGTHS:
            least = 0
            for most, room in _ROOM.items():
                rows = np.flatnonzero((size > low) & (size <= high) & (ways > least) & (ways <= most))
                least = most
                step = max(1, _CELLS // (room * most))
                for k in range(0, len(rows), step):
                    part = rows[k : k + step]
                    at = np.minimum(bounds[part][:, None] + np.arange(high), len(codes) - 1)
                    grid = np.where(np.arange(high) < size[part][:, None], codes[at], DECORATION)
                    text, length, fine = self._search(grid, most, room)
                    raw = text.tobytes()
                    for j, (i, m) in enumerate(zip(part.tolist(), length.tolist())):
                        out[i] = raw[(j + 1) * high - m : (j + 1) * high]
                    alone[part[~fine]] = True
            low = high
        for i in np.flatnonzero(alone).tolist():
            out[i] = self.restore(codes[bounds[i] : bounds[i + 1]].tolist())
        ends = np.zeros(n + 1, np.int64)
        np.cumsum([len(x) for x in out], out=ends[1:])
        return np.frombuffer(b"".join(out), np.uint8), ends

    def _search(self, grid: np.ndarray, most: int, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over the rows of a grid of codes at once: readings (at the rows' ends), their lengths, and whether room sufficed.

        A row holds up to room paths. Where a step leads to more, only the best one to each pair of last classes
        goes on; a row with more such pairs than room is reported.
        """
        n, length = grid.shape
        a = b = np.zeros((n, 1), np.int64)
        score = np.zeros((n, 1))
        fine = np.ones(n, bool)
        trace = []
        for k in range(length):
            ways = min(most, int(_WAYS[grid[:, k]].max()))
            emit, cost = _EMIT[grid[:, k], :ways], _COST[grid[:, k], :ways]
            z, none = _CLASS[emit][:, None, :], (emit == 0)[:, None, :]
            pair = (a * CLASSES + b)[:, :, None]
            s = score[:, :, None] + cost[:, None, :] + np.where(none, 0.0, self.flat[pair * CLASSES + z])
            x, y = np.where(none, a[:, :, None], b[:, :, None]), np.where(none, b[:, :, None], z)
            held = a.shape[1]
            a, b, score = x.reshape(n, -1), y.reshape(n, -1), s.reshape(n, -1)
            chosen = None
            if a.shape[1] > room:
                code = np.where(np.isfinite(score), a * CLASSES + b, CLASSES * CLASSES)
                order = np.argsort(code * 1e6 - np.where(np.isfinite(score), score, 0.0), 1)
                code = np.take_along_axis(code, order, 1)
                first = np.ones(code.shape, bool)
                first[:, 1:] = code[:, 1:] != code[:, :-1]
                first &= code < CLASSES * CLASSES
                fine &= first.sum(1) <= room
                best = np.where(first, np.take_along_axis(score, order, 1), -np.inf)
                keep = min(room, max(1, int(first.sum(1).max())))
                top = np.argsort(-best, 1)[:, :keep]
                chosen = np.take_along_axis(order, top, 1)
                a, b = np.take_along_axis(a, chosen, 1), np.take_along_axis(b, chosen, 1)
                score = np.take_along_axis(best, top, 1)
            trace.append((chosen, ways, emit))
        rows = np.arange(n)
        at = (score + self.flat[(a * CLASSES + b) * CLASSES]).argmax(1)
        text, sizes = np.zeros((n, length), np.uint8), np.zeros(n, np.int64)
        for chosen, ways, emit in reversed(trace):
            if chosen is not None:
                at = chosen[rows, at]
            byte = emit[rows, at % ways]
            at = at // ways
            some = np.flatnonzero(byte)
            sizes[some] += 1
            text[some, length - sizes[some]] = byte[some]
        return text, sizes, fine


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that start there and have these sizes."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def hints(data: np.ndarray) -> np.ndarray:
    """Positions of bytes that speak of leetspeak, separators or runs inside of a word.

    Texts lie one after another here: at a seam a token may be looked at in vain, which does not change how it reads.
    """
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    letter, leet = _LETTER[data], _LEET[data]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    # Digits and symbols count next to a letter, marks of a sentence's end only before one.
    hint = leet & (before | after) & (~_INSIDE[data] | after)
    # Up to three other characters between letters may be separators.
    other = ~letter & ~_SPACE[data]
    between = other & before
    for k in range(1, 4):
        hint[: n - k] |= between[: n - k] & letter[k:]
        between[: n - k] &= other[k:]
    hint[1:] |= letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 128)
    return np.flatnonzero(hint)


def token_lattices(seen: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lattices of tokens, spans of lower-cased bytes: token numbers, codes and n + 1 offsets.

    Punctuation around a token is no part of it. Leetspeak may stand for letters, separators for nothing or a break, letters of a pair
    for one letter, longer runs for one or two. Runs of symbols are decoration in a first lattice; short ones stand
    for letters in a second one, and a short run of stars between letters for any.
    """
    inner = np.flatnonzero(~_AROUND[seen])
    inner = np.append(inner, len(seen))
    begin = inner[np.searchsorted(inner, starts)]
    end = inner[np.searchsorted(inner, ends) - 1] + 1  # ends are beyond a first byte
    token = np.flatnonzero((begin < ends) & (end - begin > 1))
    begin, size = begin[token], (end - begin)[token]
    if not len(token):
        return token, token, np.zeros(1, np.int64)
    at = _ranges(begin, size)
    byte = seen[at].astype(np.int64)
    who = np.repeat(np.arange(len(token)), size)
    n = len(byte)
    fresh = np.ones(n, bool)
    fresh[1:] = (byte[1:] != byte[:-1]) | (who[1:] != who[:-1])
    run = np.cumsum(fresh) - 1
    heads = np.flatnonzero(fresh)
    length = np.diff(np.append(heads, n))[run]
    place = np.arange(n) - heads[run]
    ascii_letter, leet, digit = _LETTER[byte] & (byte < 128), _LEET[byte], _DIGIT[byte]
    code = np.full(n, SEPARATOR)
    code[~leet & digit] = DECORATION
    code[~_LETTER[byte] & ~leet & (place > 0)] = DECORATION
    code[_LETTER[byte]] = byte[_LETTER[byte]]
    second = ascii_letter & (place == 1)
    code[second] += np.where(length[second] == 2, PAIR, RUN)
    code[leet] = AS_LEET + byte[leet]
    symbols = leet & ~digit & (length > 1)
    code[symbols] = DECORATION
    stay = ~(ascii_letter & (place > 1))
    # The second lattices.
    short = symbols & (length <= SHORT)
    as_letters = np.zeros(len(token), bool)
    as_letters[who[short]] = True
    other = code.copy()
    other[short] = AS_LEET + byte[short]
    letter = np.append(_LETTER[byte], False)
    left, right = heads[run] - 1, heads[run] + length
    masked = short & (byte == ord("*")) & (left >= 0) & letter[left] & letter[np.minimum(right, n)] & (who[left] == who) & (who[np.minimum(right, n - 1)] == who)
    other[masked] = MASK
    chosen = [(np.flatnonzero(stay), code), (np.flatnonzero(stay & as_letters[who]), other)]
    codes = np.concatenate([c[p] for p, c in chosen])
    owner = np.concatenate([who[p] for p, _ in chosen])
    second = np.concatenate([np.full(len(p), k) for k, (p, _) in enumerate(chosen)])
    new = np.ones(len(codes), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (second[1:] != second[:-1])
    cut = np.flatnonzero(new)
    return token[owner[cut]], codes, np.append(cut, len(codes))


def chain_lattices(seen: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lattices of chains of three or more single letters (or leetspeak) with up to APART other characters between them.

    Text numbers, codes and n + 1 offsets. Every gap may be nothing or a word break, which is likelier where a gap is wider than
    the chain's others. A word of one letter may stand before or after, so each chain is also read without its ends.
    """
    n = len(seen)
    none = np.zeros(0, np.int64)
    part = _LETTER[seen] | _DIGIT[seen]
    single = (_LETTER[seen] & (seen < 128)) | _LEET[seen]
    edge = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = part[:-1], part[1:]
    before[edge] = after[edge - 1] = False  # texts do not touch
    at = np.flatnonzero(single & ~before & ~after)
    if len(at) < 3:
        return none, none, np.zeros(1, np.int64)
    text = np.searchsorted(bounds, at, side="right") - 1
    gap = np.diff(at)
    # Symbols that touch each other are no single letters.
    tied = (gap <= APART + 1) & (gap > 1) & (text[1:] == text[:-1])
    fresh = np.append(True, ~tied)
    heads = np.flatnonzero(fresh)
    size = np.diff(np.append(heads, len(at)))
    letters = np.add.reduceat((_LETTER[seen[at]]).astype(np.int64), heads)
    heads, size = heads[(size > 2) & (letters > 1)], size[(size > 2) & (letters > 1)]
    if not len(heads):
        return none, none, np.zeros(1, np.int64)
    unit = seen[at].astype(np.int64)
    unit += np.where(_LETTER[seen[at]], 0, AS_LEET)
    gap = np.append(gap, APART + 2)
    inside = _ranges(heads, size - 1)
    least = np.minimum.reduceat(gap[inside], np.cumsum(size - 1) - (size - 1))
    wide = np.zeros(len(at), np.int64)
    wide[inside] = np.where(gap[inside] > np.repeat(least, size - 1), WIDE, GAP)
    # Without the first, the last, or both.
    starts = np.concatenate([heads, heads + 1, heads, heads + 1])
    sizes = np.concatenate([size, size - 1, size - 1, size - 2])
    starts, sizes = starts[sizes > 2], sizes[sizes > 2]
    places = _ranges(starts, sizes)
    codes = np.stack([unit[places], wide[places]], 1).ravel()
    last = np.cumsum(2 * sizes) - 1  # no gap after the last
    codes = np.delete(codes, last)
    edges = np.concatenate([[0], np.cumsum(2 * sizes - 1)])
    fine = np.add.reduceat(codes < AS_LEET, edges[:-1]) > 1
    if fine.all():
        return text[starts], codes, edges
    codes = codes[np.repeat(fine, 2 * sizes - 1)]
    return text[starts[fine]], codes, np.concatenate([[0], np.cumsum(2 * sizes[fine] - 1)])


def restored_words(data: np.ndarray, bounds: np.ndarray, tokens: Words, model: CharacterModel) -> tuple[np.ndarray, Words | None, np.ndarray]:
    """Text numbers of the restored words of obfuscated tokens and chains, those words, and which of them each is.

    tokens: the texts' words at white space, in lower case. Equal tokens are decoded once.
    """
    seen = _LOWER[data]
    none = np.zeros(0, np.int64)
    at = np.unique(np.searchsorted(tokens.starts, hints(data), side="right") - 1)
    at = at[at >= 0]
    _, first, same = np.unique(tokens.hashes[at], return_index=True, return_inverse=True)
    own, codes, edges = token_lattices(seen, tokens.starts[at[first]], tokens.ends[at[first]])
    text_of, chains, chain_edges = chain_lattices(seen, bounds)
    if not len(codes) and not len(chains):
        return none, None, none
    raw, ends = model.restored(np.concatenate([codes, chains]), np.concatenate([edges, edges[-1] + chain_edges[1:]]))
    words = Words(raw, ends, False, _NOT_LETTER)
    # A token's readings, for each place where the token stands.
    order = np.argsort(own, kind="stable")
    low, high = np.searchsorted(own[order], same), np.searchsorted(own[order], same, side="right")
    reading = np.concatenate([order[_ranges(low, high - low)], len(own) + np.arange(len(text_of))])
    text = np.searchsorted(tokens.first, at, side="right") - 1
    text = np.concatenate([np.repeat(text, high - low), text_of])
    count = np.diff(words.first)[reading]
    return np.repeat(text, count), words, _ranges(words.first[reading], count)


def readings(text: str, model: CharacterModel) -> list[str]:
    """What the obfuscated parts of a text may say: tokens in the order of their hashes, then chains of single letters."""
    data = np.frombuffer(text.encode(), np.uint8)
    bounds = np.array([0, len(data)])
    _, words, at = restored_words(data, bounds, Words(data, bounds, True), model)
    return [words.strings(k, k + 1)[0].decode() for k in at.tolist()]


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = column_bytes(column)
    n, a = len(offsets) - 1, 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE_BYTES, side="right")) - 1))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def evidence(data: np.ndarray, bounds: np.ndarray, model: CharacterModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text numbers, whole-word hashes and, per row, the hashes of word and beginnings, for letters' runs and restored words."""
    plain = Words(data, bounds, True, _NOT_LETTER)
    text, again, at = restored_words(data, bounds, Words(data, bounds, True), model)
    parts = [(np.repeat(np.arange(len(plain)), np.diff(plain.first)), plain, slice(None))]
    if again is not None:
        parts.append((text, again, at))
    text = np.concatenate([t for t, _, _ in parts])
    whole = np.concatenate([w.hashes[k] for _, w, k in parts])
    features = np.stack([whole, *(np.concatenate([w.prefixes(n)[k] for _, w, k in parts]) for n in BEGINNINGS)], 1)
    return text, whole, features


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of byte-class trigrams over all texts; each task sends one row for each trigram that it has seen."""

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for _, _, data, _ in _pieces(batch.column(0)):
                c = np.concatenate([[0, 0], _CLASS[data], [0]])
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    out = np.zeros(CLASSES**3, np.int64)
    for row in docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[row.gram] = row.n  # at most CLASSES ** 3 rows, for any corpus
    return out


def held_out(id_column: str = "doc_id"):
    """Rows that labels are never learned from: crc32 of the id as text leaves 1 when divided by 3, or the id is null."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """The tables of a scorer: trigram counts over all texts, and the evidence of words in labelled ones.

    Evidence is the lower Wilson bound of the share of toxic texts among those with the word or beginning, counted
    over texts whose least 5-word shingle hashes differ, so that copies of a text count once. Labels come from at
    most fit_rows rows that are not held out; null labels are ignored; without labels there is no evidence.
    """
    ship(docs.sparkSession)
    counts = trigram_counts(docs)
    rows = labels.filter(F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = saved(docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id"), "toxicity-fit")

    def sketch(batches):
        for batch in batches:
            least = []
            for _, _, data, bounds in _pieces(batch.column(2)):
                words = Words(data, bounds, True)
                for k in range(len(words)):
                    g = grams(words.of(k), 5)
                    g = g if len(g) else mix(words.of(k))
                    least.append(int(g.min().view(np.int64)) if len(g) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least, pa.int64())], names=["doc_id", "toxic", "sketch"])

    first = texts.select("doc_id", "toxic", "text").mapInArrow(sketch, "doc_id long, toxic long, sketch long")
    first = first.groupBy("sketch", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    texts = saved(texts.join(F.broadcast(first), "doc_id", "left_semi"), "toxicity-words")  # ids of fit_rows rows at most

    def feature_counts(columns: slice, only: np.ndarray | None, skip: np.ndarray):
        def run(batches):
            model = CharacterModel(counts)
            for batch in batches:
                for a, b, data, bounds in _pieces(batch.column(1)):
                    text, whole, features = evidence(data, bounds, model)
                    features = np.where(np.isin(whole, skip)[:, None], np.uint64(0), features[:, columns])
                    keys = features.ravel()
                    who = np.repeat(text, features.shape[1])
                    fine = keys != 0 if only is None else np.isin(keys, only)
                    pairs = np.unique(np.stack([keys[fine], who[fine].astype(np.uint64)], 1), axis=0)
                    label = np.array(batch.column(0).slice(a, b - a).to_pylist(), np.int64)[pairs[:, 1].astype(np.int64)]
                    key, at = np.unique(pairs[:, 0], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64)), *(pa.array(np.bincount(at, label == x, len(key)).astype(np.int64)) for x in (1, 0))],
                        names=["key", "bad", "good"],
                    )

        return run

    part, shape = texts.select("toxic", "text"), "key long, bad long, good long"

    def learned(columns: slice, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = part.filter("toxic = 1").mapInArrow(feature_counts(columns, None, skip), shape)
        bad = {r.key: r.bad for r in found.groupBy("key").agg(F.sum("bad").alias("bad")).filter("bad >= 3").collect()}
        if not bad:
            return np.zeros(0, np.uint64), np.zeros(0)
        only = np.array(list(bad), np.int64).view(np.uint64)
        found = part.filter("toxic = 0").mapInArrow(feature_counts(columns, only, skip), shape)
        good = dict(found.groupBy("key").agg(F.sum("good")).collect())
        n1 = np.array(list(bad.values()), float)
        n = n1 + np.array([good.get(k, 0) for k in bad], float)
        p = n1 / n
        low = (p + Z * Z / (2 * n) - Z * np.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
        return only[low >= LEAST], np.log1p(-np.minimum(low[low >= LEAST], 0.999))

    # Beginnings speak for words that are no evidence themselves, as rare compounds of a toxic stem.
    keys, weights = learned(slice(0, 1), np.zeros(0, np.uint64))
    more, their = learned(slice(1, None), keys)
    keys, weights = np.concatenate([keys, more]), np.concatenate([weights, their])
    order = np.argsort(keys)
    return {"counts": counts, "keys": keys[order], "weights": weights[order]}


def score_piece(data: np.ndarray, bounds: np.ndarray, tables: dict, model: CharacterModel) -> np.ndarray:
    """Scores of texts: 1 minus the chance that none of their distinct words is toxic, each word by its strongest evidence."""
    n = len(bounds) - 1
    keys, weights = tables["keys"], tables["weights"]
    log = np.full(n, np.log1p(-BASE))
    if len(keys):
        text, whole, features = evidence(data, bounds, model)
        at = np.minimum(np.searchsorted(keys, features), len(keys) - 1)
        best = np.where(keys[at] == features, weights[at], 0.0).min(1)
        hit = np.flatnonzero(best < 0)
        _, one = np.unique(np.stack([text[hit].astype(np.uint64), whole[hit]], 1), axis=0, return_index=True)
        log += np.bincount(text[hit[one]], best[hit[one]], n)
    return -np.expm1(log)


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from THRESHOLD on).

    Null and empty texts have the base score; repeated rows are each scored; empty tables and missing labels give the
    base score; only doc_id and text of docs are read.
    """
    ship(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # of bounded size

    def run(batches):
        model = CharacterModel(tables.value["counts"])
        for batch in batches:
            scores = [score_piece(data, bounds, tables.value, model) for _, _, data, bounds in _pieces(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that are not predicted toxic, as they are; nothing is shuffled."""
    ship(docs.sparkSession)
    tables = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fit_rows))  # of bounded size
    at = docs.columns.index("text")

    def run(batches):
        model = CharacterModel(tables.value["counts"])
        for batch in batches:
            scores = [score_piece(data, bounds, tables.value, model) for _, _, data, bounds in _pieces(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate(scores) < THRESHOLD if scores else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
