import collections
import math
import os
import random
import re
import struct
import subprocess
import sys
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute_alignment  # noqa: E402

from threadloom.llm import alignment, divergence, packing  # noqa: E402

pytest.importorskip("public_tokenizers")

ODD_TEXTS = [
    None, "", " ", "\n", " \n\t", "a", "same", "same", "Zwei  Leerzeichen\n\nund Absätze ", "tab\there;\r", "end;\r", "been ;\r\n x\x0b y", "<|endoftext|> stays <s> text", "A<|endoftext|>b <|STARTOFTEXT|>", "1234 56.7% #tag",
    "▁marked▁text", "half▁way x", "été 漢字 😀 \x85   é ΣΑΣ İ", "\x00 nul\x1c sep", "it's we'll I'D don't", "trailing\t", "  nbsp　wide", "x" * 5000, "\n \n  indent\n    more", "ﬁ ﬂ ½ K",
]


def frame(spark, texts, **more):
    """Rows with repeated and null ids and columns named as inside of the operators."""
    rows = [(None if k % 11 == 7 else k // 2, t, None if k % 5 == 4 else f"l{k % 3}", None if k % 7 == 6 else f"s{k % 4}", k, k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, block long, length long").repartition(3)


def random_texts(seed, n, words=60):
    rng = random.Random(seed)
    syllables = ["tion", "er", "Th", "e", "in", "g", "ß", "漢", "é", "1", "27", "'s", ".", ",", "--"]
    gap = [" ", " ", " ", " ", "  ", "\n", "\t", " \n ", " ", "\r\n"]
    return ["".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) + rng.choice(gap) for _ in range(rng.randint(0, words))) for _ in range(n)]


# -- source divergence ----------------------------------------------------------------------------------------------------------


def brute_divergences(rows, least=3, ranks=200):
    """Rows (lang, source, part, item, value, rank) as defined, with whole numbers of any size."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    low = {c: c + 32 for c in range(65, 91)}
    docs, count, seen = set(), collections.Counter(), collections.Counter()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        docs.add((lang, source))
        found = term.findall((text or "").translate(low))
        count.update((lang, source, t) for t in found)
        seen.update((lang, t) for t in set(found))
    out = []
    for lang in {a for a, _ in docs}:
        kept = [t for (a, t), n in seen.items() if a == lang and n >= least]
        sources = sorted((s for a, s in docs if a == lang), key=str.encode)
        table = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        total = {t: sum(table[s][t] for s in sources) for t in kept}

        def shares(c):
            whole = sum(c.values()) + len(kept)
            return {t: 1 + math.floor(Fraction(10**9 * (n + 1), whole)) for t, n in c.items()}

        p, q = {s: shares(table[s]) for s in sources}, shares(total)
        f = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if table[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


def spark_divergences(df, **more):
    return sorted(tuple(r) for r in divergence.divergences(df, **more).collect())


def test_divergences_equal_brute_force(spark, monkeypatch):
    """Small chunks, spans and blocks, so that vectors meet over many tiles; a group without terms and a language without kept ones."""
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "CHUNK", 7)
    monkeypatch.setattr(divergence, "SPAN", 2)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    rng = random.Random(5)
    words = ["Été", "Ete", "ete", "漢字", "été", "A", "a", "b9c", "x-y", "İ"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(160):
        source = rng.choice([f"s{j}" for j in range(7)] + [None, "", "ü"])
        rows.append((rng.choice(["en", "en", "fr", None]), source, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 40)))))
    rows += [("en", "empty", None), ("en", "void", "12 . 34"), ("xx", "one", "lonely words"), ("xx", "two", "others here"), ("yy", "only", "a a a"), ("yy", "only", "a b"), ("yy", "only", "a")]
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"place": F.lit(1), "chunk": F.lit("x"), "whole": F.lit(2)}).repartition(4)
    want = brute_divergences(rows)
    assert spark_divergences(df) == want
    assert {w[2] for w in want if w[0] == "xx"} == {"pair"} and not [w for w in want if w[0] == "yy" and w[2] == "pair"]


def test_divergences_of_odd_rows_and_none(spark):
    df = frame(spark, ODD_TEXTS * 3)
    assert spark_divergences(df) == brute_divergences([(r.lang, r.source, r.text) for r in df.collect()])
    assert spark_divergences(df.limit(0)) == []


def test_term_ranks_keep_the_first(spark):
    rows = [("en", f"s{k % 2}", " ".join(f"t{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(k % 2, 300, 2))) for k in range(8)]
    got = spark_divergences(spark.createDataFrame(rows, "lang string, source string, text string"), term_ranks=20)
    assert got == brute_divergences(rows, ranks=20)


def test_shares_are_exact_for_large_counts(spark):
    rng = random.Random(1)
    rows = [(n - 1, w) for w in (1, 3, 10**9 + 7, 8_999_999_999_999_999) for n in [w, 1, *[rng.randint(1, w) for _ in range(50)]]]
    want = [1 + 10**9 * (n + 1) // w for n, w in rows]
    assert [int(divergence.shares(np.array([n]), w)[0]) for n, w in rows] == want
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, n long, w long")
    assert [r.p for r in df.select("k", divergence.share(F.col("n"), F.col("w")).alias("p")).orderBy("k").collect()] == want


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 10)
    text = "Ab cd " * 50 + "é" * 40 + " end"
    assert [t for part in divergence.terms_of(text.encode()) for t in part] == re.findall(rb"[a-z\x80-\xff]+", text.encode().lower())


# -- packing --------------------------------------------------------------------------------------------------------------------


def pieces_of(texts, tokens):
    import public_tokenizers
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for text in texts:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append([(k // tokens, k, ids[k : k + tokens]) for k in range(0, len(ids), tokens)])
    return out


def check_sequences(rows, tokens, documents=10**9, attention=10**18):
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= tokens and len(parts) <= documents and sum(n * n for _, n in parts) <= attention
    return held


@pytest.mark.parametrize("together", [1, 3, 256])
def test_ids_equal_the_library(together, monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", together)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        encoder = packing.WordEncoder(f.read())
    texts = [t or "" for t in ODD_TEXTS] + random_texts(2, 60)
    for _ in range(2):
        got = [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in encoder.encode_batch([t.encode() for t in texts])]
        assert [[*x, 1] for x in got] == [[i for _, _, ids in p for i in ids] for p in pieces_of(texts, 1 << 30)]


def test_packed_documents(spark):
    texts = ODD_TEXTS + random_texts(3, 80, 200)
    docs = frame(spark, texts)
    rows = packing.pack_documents(docs, packing.default_tokenizer(), tokens=64).collect()
    want = collections.Counter()
    plain = docs.select("doc_id", "text").collect()
    for r, p in zip(plain, pieces_of([r.text for r in plain], 64)):
        want.update((r.doc_id, k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), struct.pack(f"<{len(ids)}I", *ids)) for k, start, ids in p)
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in rows) == want
    held = check_sequences(rows, 64)
    assert len(held) <= 1.03 * sum(r.length for r in rows) / 64 + 1
    assert packing.pack_documents(docs.limit(0), packing.default_tokenizer()).collect() == []


def test_sequences_hold_their_pieces(spark):
    packed = packing.pack_documents(frame(spark, random_texts(4, 30)), packing.default_tokenizer(), tokens=50).cache()
    held = collections.defaultdict(dict)
    for r in packed.collect():
        held[r.sequence_id][r.offset] = bytes(r.ids)
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(x for _, x in sorted(held[r.sequence_id].items()))
        assert r.lengths == [len(x) // 4 for _, x in sorted(held.pop(r.sequence_id).items())]
    assert not held


def test_every_capacity_holds_over_all_levels(spark, monkeypatch):
    """Small shards, so that emptiest sequences pass through several levels; one key of the pieces holds a third of all rows."""
    monkeypatch.setattr(packing, "SHARD", 40)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    monkeypatch.setattr(packing, "HANDED", 6)
    rng = random.Random(8)
    rows = [(k, 7 if k % 3 == 0 else k, rng.randint(1, 100)) for k in range(1500)]
    pieces = spark.createDataFrame(rows, "piece_key long, doc_id long, length long").withColumns({"documents": F.lit(1).cast("long"), "attention": F.expr("length * length")})
    for rule in ("norm", "dot"):
        for capacities in ({"length": 256}, {"length": 256, "documents": 4, "attention": 20_000}):
            got = packing.pack(pieces, capacities, {"documents": 0.1, "attention": 0.5}, rule).collect()
            assert sorted((r.piece_key, r.doc_id, r.length) for r in got) == rows
            held = check_sequences(got, 256, capacities.get("documents", 10**9), capacities.get("attention", 10**18))
            bound = max(sum(r.length for r in got) / 256, sum(r.attention for r in got) / capacities.get("attention", 10**18), 1500 / capacities.get("documents", 10**9))
            assert len(held) <= 1.04 * bound + 1
    assert {s >> 58 for s in held} == {0, 1, 2, 3, 4}


def test_best_fit_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    sizes = np.stack([rng.integers(1, 60, 300), np.ones(300, int), rng.integers(0, 900, 300)], axis=1)
    caps, w = np.array([100, 5, 1500]), np.array([1.0, 0.2, 0.7])
    for rule in ("norm", "dot"):
        left, want = [], {}
        for k in sorted(range(300), key=lambda k: (-max(sizes[k] / caps), k)):
            fits = [j for j, r in enumerate(left) if (r >= sizes[k]).all()]
            after = {j: (left[j] - sizes[k]) / caps for j in fits}
            score = {j: float(w @ (x * x) if rule == "norm" else (w * sizes[k] / caps) @ x) for j, x in after.items()}
            if not fits:
                left.append(caps.copy())
                score = {len(left) - 1: 0.0}
            least = min(score.values())
            want[k] = [j for j, s in score.items() if math.isclose(s, least, rel_tol=1e-12, abs_tol=1e-15)], len(left)
            j = want[k][0][0]
            left[j] = left[j] - sizes[k]
        got = packing.best_fit(sizes, caps, w, rule)
        assert abs(int(got.max()) + 1 - len(left)) <= 2  # ties may go to other bins
        for j in range(int(got.max()) + 1):
            assert (sizes[got == j].sum(axis=0) <= caps).all()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[101, 1, 1]]), caps, w)


# -- alignment ------------------------------------------------------------------------------------------------------------------


def test_bits():
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 1000):
        x, y = (np.flatnonzero(rng.random(n + 1) < 0.3) for _ in range(2))
        a, b = alignment.Bits.of(x, n), alignment.Bits.of(y, n)
        assert (a & b).select().tolist() == sorted(set(x) & set(y)) and (a | b).select().tolist() == sorted(set(x) | set(y))
        assert a.rank(np.arange(n + 1)).tolist() == [int((x <= k).sum()) for k in range(n + 1)]


def test_units_are_whole_texts():
    for t in [" " + (t or "") for t in ODD_TEXTS] + [" " + t for t in random_texts(6, 100)]:
        assert "".join(alignment.units(t)) == t == "".join(alignment.UNIT.findall(t))
        if not alignment._OTHER_SPACE.search(t):
            assert alignment.units(t) == alignment.UNIT.findall(t)


def aligned(df):
    got = alignment.align_documents(df, *alignment.default_tokenizers())
    return collections.Counter(tuple(r) for r in got.collect())


def brute_aligned(df):
    rows = df.select("doc_id", "text").collect()
    return collections.Counter((r.doc_id, *x) for r, x in zip(rows, brute_alignment.alignments([r.text for r in rows], *alignment.default_tokenizers())))


def test_alignment_equals_brute_force(spark):
    df = frame(spark, ODD_TEXTS + random_texts(7, 150))
    got, want = aligned(df), brute_aligned(df)
    assert got == want
    assert sum(1 for x in want if x[1] == 0) >= 4 and any(x[1] for x in want)
    assert not aligned(df.limit(0)) and aligned(frame(spark, [None, ""])) == brute_aligned(frame(spark, [None, ""]))


def test_blocks_share_counts(spark):
    """Blocks of a few units, closed in the middle of a partition; counts are still those of all documents. Forked workers read the
    limits from the module, so they are set where they run."""
    block = alignment.Block(alignment.Aligner(*alignment.default_tokenizers()))
    texts = [t or "" for t in ODD_TEXTS] + random_texts(9, 40)
    counts, groups, flat, sizes = block.add(texts)
    again = alignment.Block(block.aligner)
    parts = [again.add([t]) for t in texts]
    assert np.concatenate([p[0] for p in parts]).tolist() == counts.tolist() and [g for p in parts for g in p[1]] == groups
    a, b = block.closed(), again.closed()
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_blocks_end_by_bytes():
    """A block of few but long units, or of texts that are kept as a whole, ends by what it holds."""
    aligner = alignment.Aligner(*alignment.default_tokenizers())
    block, n = alignment.Block(aligner), 0
    while not block.full() and n < 200:
        block.add([f"{n}-" + "word-and-" * 20_000])
        n += 1
    assert block.full() and len(block.texts) == n and block.total == n
    held = sum(map(len, block.texts)) + sum(map(len, block.at)) + block.codes.nbytes + sum(x.nbytes for x in block.seen)
    assert held <= block.bytes < alignment.BLOCK_BYTES + 2e6


def test_tokenizers_keep_to_one_thread():
    """A task has one core. In a process of its own, as the library reads the setting when it starts its threads."""
    for module, made in (("alignment", "x.Aligner(*x.default_tokenizers()).align([f' w{k}' for k in range(20000)])"), ("packing", "list(x.WordEncoder(open(x.default_tokenizer()).read()).encode_batch([b'w%d' % k for k in range(20000)]))")):
        code = f"import os\nfrom threadloom.llm import {module} as x\nbefore = len(os.listdir('/proc/self/task'))\n{made}\nprint(len(os.listdir('/proc/self/task')) - before)"
        env = {k: v for k, v in os.environ.items() if k not in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS")}
        out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env=env, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
        assert out.stdout.strip() == "0", (module, out)


def test_linked_pairs(spark):
    texts = random_texts(10, 40)
    got = {(r.a, r.b): (r.docs, r.best) for r in alignment.linked_pairs(frame(spark, texts), *alignment.default_tokenizers()).collect()}
    most = collections.defaultdict(int)
    for (a, _), (n, _) in got.items():
        most[a] = max(most[a], n)
    assert got and all(best == (n == most[a]) for (a, _), (n, best) in got.items())


def test_vocabularies_that_cross_units_are_refused(monkeypatch):
    monkeypatch.setattr(re, "search", lambda pattern, text: True)
    with pytest.raises(ValueError):
        alignment.Aligner(*alignment.default_tokenizers())


def test_totals_of_blocks_add_up():
    run = alignment._totals("doc_id", pa.int64())
    u = lambda x, form: np.array(x, form).tobytes()
    left = pa.table({
        "block": [1, 1, 1], "doc_id": [5, None, None], "n_a": [1, 2, 0], "n_b": [1, 2, 0], "n_groups": [1, 1, 0], "n_links": [3, 0, 0], "groups_sha256": ["x", "", ""],
        "low": [u([0, 1, 0], "<u2"), b"", b""], "high": [b"", b"", b""], "sizes": [None, None, u([1, 2], "<u4")], "links": [None, None, u([1, 0, 1], "<u4")],
    })
    right = pa.table({"block": [1, 1], "pair": [9, 4], "docs": [7, 100], "best": [True, False]})
    assert run(left, right).select(["doc_id", "n_best", "count_sum"]).to_pydict() == {"doc_id": [5, None], "n_best": [3, 0], "count_sum": [7 * 3 + 100, 0]}
