import hashlib
import math
import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from threadloom.llm import common, exact, lm, mixing, neardup, quality, substrings, toxicity, urls  # noqa: E402

VOCABULARY = ["alpha", "beta", "Gamma", "delta", "eps", "the", "of", "and", "zeta", "été", "漢字", "x1", "long-word", "."] + [f"w{k}" for k in range(300)]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def edited(rng, text, share):
    w = text.split()
    return " ".join(rng.choice(VOCABULARY) if rng.random() < share else x for x in w)


def documents(spark, rows):
    """Rows with columns whose names clash with the operators' own."""
    full = [(i, t, "en" if k % 3 else None, f"s{k % 3}" if k % 5 else None, len(t or ""), k, "x") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, n_words long, digest string")


ODD = [(1, "same"), (2, "same"), (2, "same"), (3, None), (4, ""), (None, "same"), (None, None), (5, " \n\t"), (6, "a b"), (7, "A  B"), (8, "x" * 100_000), (9, "word " * 20_000), (10, "été 漢字 😀 \x85 \u2028")]


def test_every_operator_takes_odd_rows_and_none(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (ODD, []):
        docs = documents(spark, rows)
        assert exact.exact_groups(docs).count() == len(rows)
        assert neardup.near_groups(docs).count() == len(rows)
        assert substrings.remove_repeats(docs).count() == len(rows)
        assert quality.judge_quality(docs, labels).count() == quality.judge_quality(docs, labels.limit(0)).count() == len(rows)
        assert toxicity.score_documents(docs, labels).count() == len(rows)
        assert lm.score_documents(docs).count() == len(rows)
        assert mixing.mix_sources(docs).select("doc_id").distinct().count() == len({i for i, _ in rows})


# -- exact ----------------------------------------------------------------------------------------------------------------------


def test_exact_groups(spark):
    got = {(r.doc_id, r.text_sha256): r for r in exact.exact_groups(documents(spark, ODD)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert (got[1, sha("same")].keep_id, got[1, sha("same")].group_size, got[1, sha("same")].kept) == (2, 4, False)
    assert got[2, sha("same")].kept and not got[None, sha("same")].kept
    assert (got[3, sha("")].keep_id, got[3, sha("")].group_size) == (4, 3)


def test_kept_rows(spark):
    docs = documents(spark, ODD)
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id < 8").collect()) == [(2, "same"), (4, ""), (5, " \n\t"), (6, "a b"), (7, "A  B")]


# -- urls -----------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "https://example.net/", "example.net", "/", "net/", "block"),
        (3, "https://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"),
        (4, "https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        (5, "x://b.org/fr/://net/", "b.org", "/fr/://net/", "org/fr/", "allow"),
        (6, None, "", "", None, "allow"),
        (7, "no scheme net/", "", "", None, "allow"),
        (8, "http://net", "net", "", None, "allow"),
        (9, "http://net?x/", "net", "", None, "allow"),
        (10, "http://" + "a." * 5000 + "net/" + "p" * 50_000, "a." * 5000 + "net", "/" + "p" * 50_000, "net/", "block"),
        (2, "https://example.net/", "example.net", "/", "net/", "block"),
    ]
    pages = spark.createDataFrame([r[:2] + ("clash", "clash") for r in rows], "page_id long, url string, host string, digest string")
    got = sorted((tuple(r) for r in urls.judge_urls(pages, urls.rule_table(spark)).collect()), key=str)
    assert got == sorted(((r[0], *r[2:]) for r in rows), key=str)
    assert urls.judge_urls(pages.limit(0), urls.rule_table(spark)).count() == 0
    assert urls.judge_urls(pages, urls.rule_table(spark).limit(0)).filter("verdict = 'block'").count() == 0


def test_many_rules_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urls, "BROADCAST_RULES", 3)
    rng = random.Random(1)
    rules = [(f"h{rng.randint(0, 30)}.net", "/" + "ab"[: rng.randint(0, 2)], rng.choice(["allow", "block"])) for _ in range(40)]
    pages = [(k, f"http://s.h{rng.randint(0, 40)}.net/{'abc'[: rng.randint(0, 3)]}") for k in range(200)]
    got = {r.page_id: r.rule for r in urls.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), urls.rule_table(spark, rules)).collect()}
    for k, u in pages:
        host, _, path = u[7:].partition("/")
        fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        assert got[k] == (max(fits, key=len) if fits else None)


# -- quality --------------------------------------------------------------------------------------------------------------------


def test_features_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["", "a b c a b c", "x x x x", "a\nb\na\n \n\na", "#|$ <>", *(prose(rng, rng.randint(0, 60)) + "\n" + prose(rng, 5) for _ in range(40)), *("the of and " * rng.randint(1, 9) for _ in range(5))]
    out = quality.text_features(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in out:
        t = texts[r.doc_id]
        lines = [x for x in t.split("\n") if brute.words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(brute.words(t)), sum(map(len, brute.words(t))), sum(c in "#*$%&|<>" for c in t))
        assert (r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(lines), len(lines) - len(set(lines)), brute.repeated_words(t))


def test_binomial_tail_is_exact(spark):
    for k, n, p in [(0, 100, 0.02), (1, 100, 0.02), (3, 1000, 0.01), (40, 10_000, 0.004)]:
        got = spark.sql(f"SELECT CAST({k} AS bigint) AS k, CAST({n} AS bigint) AS n").select(F.expr(quality.binomial_tail_sql("k", "n", p))).first()[0]
        assert got == pytest.approx(1.0 if k > n * p else sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_false_rejections_stay_within_the_limit(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(3000):
        bad = k % 4 == 0
        t = prose(rng, 80)
        rows.append((k, " ".join(w + "$#" for w in t.split()) if bad and rng.random() < 0.8 else t))
        labels.append((k, int(not bad), 0))
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    out = quality.judge_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    good = [r.kept for r in out if r.doc_id % 4]
    assert sum(good) >= (1 - quality.ALPHA) * len(good)
    assert sum(not r.kept for r in out if r.doc_id % 4 == 0) > 500


# -- near duplicates ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_groups_equal_brute_force(spark, size, percent):
    rng = random.Random(size)
    rows = [(k, prose(rng, rng.randint(0, 90))) for k in range(0, 60)]
    base = prose(rng, 110)
    rows += [(1000 + k, edited(rng, base, rng.choice([0.0, 0.01, 0.02, 0.03, 0.05, 0.1]))) for k in range(170)]  # a crowd around a base that is not among them
    rows += [(500 + k, edited(rng, rows[k][1], 0.02)) for k in range(30)]
    rows += [(2000, "One two"), (2001, "one TWO"), (2002, "two one"), (2003, None), (2004, "  ")]
    want = brute.near_groups(rows, size, percent)
    got = {r.doc_id: r for r in neardup.near_groups(documents(spark, rows), size, percent).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    stay = {r.doc_id for r in neardup.drop_near_copies(documents(spark, rows), size, percent).collect()}
    assert stay == {i for i, (_, c) in want.items() if i == c}


def test_links_at_the_least_similarity_are_found(spark):
    """Pairs of a similarity of 0.849 and 0.867, in small groups, and in a crowd of others that derive from their base."""
    rng = random.Random(21)
    rows, n = [], 0
    for k in range(150):
        w = prose(rng, 100).split()
        rows.append((10 * k, " ".join(w)))
        cut = rng.choice([7, 8])  # 98 shingles, of which so many words at an end take as many with them
        rows.append((10 * k + 1, " ".join([*w[:-cut], *(f"n{n + j}" for j in range(cut))])))
        n += cut
    base = prose(rng, 300)
    rows += [(5000 + k, edited(rng, base, rng.choice([0.01, 0.02, 0.03, 0.2, 0.4]))) for k in range(300)]
    want = brute.near_groups(rows, 3, 85)
    links = sum(i != c for i, (_, c) in want.items() if i < 5000)
    assert links > 60
    got = {r.doc_id: r.component_id for r in neardup.near_groups(documents(spark, rows), 3, 85).collect()}
    assert {i: c for i, (_, c) in want.items()} == got


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_structured_words_do_not_collide(spark):
    long = thue_morse(4096)
    other = long.translate(str.maketrans("ab", "ba"))
    assert neardup.near_groups(documents(spark, [(1, f"{long} w0"), (2, f"{other} w0")])).filter("component_id = doc_id").count() == 2
    w = [f"w{k}" for k in range(12)]
    rows = [(1, " ".join([long, *w, thue_morse(1024)])), (2, " ".join([other, *w, thue_morse(1024).translate(str.maketrans("ab", "ba"))]))]
    assert [r.n_removed for r in substrings.remove_repeats(documents(spark, rows)).collect()] == [0, 0]


def test_limits_follow_the_similarity():
    assert [(x.first, x.last) for x in map(neardup.Limits, (50, 80, 85, 95))] == [(1, 1), (3, 4), (3, 5), (3, 5)]
    assert 0.6 < neardup.Limits(80).estimate < neardup.Limits(85).estimate < 0.7


def test_bound_never_rejects_links():
    import numpy as np

    rng = np.random.default_rng(4)
    sets = []
    base = rng.integers(0, 1 << 60, 120, dtype=np.uint64)
    for _ in range(80):
        keep = rng.random(120) < rng.choice([1, 0.97, 0.9, 0.8])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 60, rng.integers(0, 20), dtype=np.uint64)])))
    n = np.array([len(s) for s in sets])
    first = [s[: len(s) - -(-85 * len(s) // 100) + 1] for s in sets]
    rare = np.full((len(sets), max(map(len, first))), np.iinfo(np.uint64).max)
    for k, f in enumerate(first):
        rare[k, : len(f)] = f
    a, b = map(np.array, zip(*[(i, j) for i in range(80) for j in range(i)]))
    may = neardup.may_link(rare, n, a, b, 85)
    linked = np.array([100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])) for i, j in zip(a, b)])
    assert linked.any() and may[linked].all() and not may.all()


# -- repeated passages ----------------------------------------------------------------------------------------------------------


def passages(rng, n=80):
    shared = [prose(rng, rng.randint(10, 60)) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = [prose(rng, rng.randint(0, 40)) for _ in range(3)] + rng.sample(shared, rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((k, "  ".join(parts)))
    return rows + [(n + 1, rows[3][1]), (n + 2, "the " * 60), (n + 3, "the " * 30), (n + 4, None), (3, rows[3][1]), (n + 5, "short")]


@pytest.mark.parametrize("heavy", [2_000, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rows = passages(random.Random(heavy))
    out = substrings.remove_repeats(documents(spark, rows))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect())
    assert got == sorted(brute.repeats(rows))
    assert sum(r[2] for r in got) > 100
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out.collect())


def test_automaton():
    rng = random.Random(5)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 30))] for _ in range(12)]
    a = substrings.SuffixAutomaton()
    for k, t in reversed(list(enumerate(texts))):
        a.add(t, k)
    a.close()
    for query in [*texts, [rng.choice("abc") for _ in range(40)]]:
        for size in (1, 3, 6):
            want = []
            for k in range(len(query) - size + 1):
                g = query[k : k + size]
                want.append(min((d for d, t in enumerate(texts) if any(t[i : i + size] == g for i in range(len(t)))), default=None))
            assert a.first_documents(query, size) == want


def test_held_sequences_are_not_matched_again():
    rng = random.Random(8)
    texts = [[rng.choice("ab") for _ in range(rng.randint(1, 30))] for _ in range(40)] + [["a"] * 25, ["a"] * 9, []]
    a = substrings.SuffixAutomaton()
    paths = [a.add(t, k % 7) for k, t in enumerate(texts)]
    assert paths == [[state for state, _ in a.matches(t)] for t in texts]
    a.close(4)
    for size in (4, 6):
        assert [a.first_documents_held(p, size) for p in paths] == [a.first_documents(t, size) for t in texts]
    assert a.first_documents(["c"] * 6 + ["a"] * 6, 6)[:6] == [None] * 6


def test_least_places():
    import numpy as np

    rng = np.random.default_rng(3)
    for width in (1, 2, 3, 7, 8, 9, 13):
        x = rng.integers(0, 6, 200).astype(np.uint64)
        assert substrings._least_places(x, width).tolist() == [k + int(np.argmin(x[k : k + width])) for k in range(201 - width)]


def test_anchors_travel_packed(monkeypatch):
    """A block hands on a row for a bucket, not one for an anchor; the anchors of two documents come out, each with all of them."""
    import numpy as np
    import pyarrow as pa

    class Table:
        """Takes down the functions that tasks get."""

        tasks: list = []

        def mapInArrow(self, function, schema):
            self.tasks.append(function)
            return self

        def __getattr__(self, name):
            return lambda *a: self

    monkeypatch.setattr(substrings, "BUCKET_BITS", 3)
    monkeypatch.setattr(substrings, "PASSED", 50)
    monkeypatch.setattr(substrings, "BLOCK", 400)
    emit, meet = substrings.shared_anchors(Table(), 13, 5).tasks
    rng = random.Random(9)
    rows = [(k, t or "") for k, t in passages(rng)] + [(500 + k, "so " * 40 + "one common line of words that very many of the documents have in them") for k in range(70)]
    rng.shuffle(rows)
    held: dict = {}
    for i, t in rows:
        words = next(substrings.pieces(pa.array([t]), False))[2]
        for x in substrings.owners(words, 13, 5)[3].view(np.int64).tolist():
            held.setdefault(x, set()).add(i)
    want = {(i, x) for x, ids in held.items() if len(ids) > 1 for i in ids}
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part]), pa.array([t for _, t in part])], names=["doc_id", "text"]) for part in (rows[:60], rows[60:90], rows[90:])]
    sent = [b for part in (batches[:1], batches[1:]) for b in emit(iter(part))]
    assert list(emit(iter([batches[0].slice(0, 0)]))) == list(emit(iter([]))) == []
    short = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["too few", ""])], names=["doc_id", "text"])
    assert sum(map(len, emit(iter([short])))) == 0
    assert sum(map(len, sent)) < sum(map(len, held.values())) / 10
    table = pa.Table.from_batches(sent).sort_by("bucket").combine_chunks()
    assert min(table["bucket"].to_pylist()) < 0 <= max(table["bucket"].to_pylist()) < 8
    for size in (1, 3, 1000):
        got = [(i, x) for b in meet(iter(table.to_batches(max_chunksize=size))) for i, x in zip(*(c.to_pylist() for c in b.columns))]
        assert set(got) == want


# -- toxicity -------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_restores(spark):
    rng = random.Random(6)
    bad = ["idiot", "moron", "scumbag"]
    rows, labels = [], []
    for k in range(1500):
        w = prose(rng, 40).split()
        if k % 6 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad) + rng.choice(["", "", "ic", "s"])
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 6 == 0)))
    hidden = [(9001, "you 1d10t and m0r0n"), (9002, "such an i d i o t here"), (9003, "what a mooooron he is"), (9004, "a fine alpha beta"), (9005, None)]
    out = toxicity.score_documents(documents(spark, rows + hidden), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in out.collect()}
    held = [(r.predicted, int(i % 6 == 0)) for i, r in got.items() if r.held_out and i < 9000]
    assert sum(p != t for p, t in held) <= 0.01 * len(held)
    assert [got[9000 + k].predicted for k in range(1, 6)] == [1, 1, 1, 0, 0]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = toxicity.drop_toxic(documents(spark, rows + hidden), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}


def test_toxicity_restores_runs_ends_and_spacing(spark):
    rng = random.Random(16)
    bad = ["asshole", "pissant", "moron", "idiot", "shit", "fag"]
    rows, labels = [], []
    for k in range(2400):
        w = prose(rng, 40).split()
        if k % 6 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        rows.append((k, " ".join(w)))
        labels.append((k, 1, int(k % 6 == 0)))
    toxic = ["an a$$hole here", "a pi$$ant he is", "such shi+ again", "you i d 1 o t", "you m 0 r o n", "you i  d  i  o  t", "you i. d. i. o. t", "a f a g", "a mor-on", "an id.iot", "a morron", "an iidiot"]
    clean = ["a fine *** alpha *** beta", "**alpha** and __beta__", "alpha!! beta (gamma)", "1 2 3 4 5 6", "a letter - tall grass", "well-known, don't $5 + $6", "", None]
    hidden = [(9000 + k, t) for k, t in enumerate(toxic + clean)]
    out = toxicity.score_documents(documents(spark, rows + hidden), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.predicted for r in out.collect()}
    assert {t: got[i] for i, t in hidden} == {**dict.fromkeys(toxic, 1), **dict.fromkeys(clean, 0)}


def character_model(rng):
    import numpy as np

    text = " ".join(rng.choice(["idiot", "moron", "asshole", "letter", "suck", "well", "known", "the", "bottle"]) for _ in range(4000))
    c = np.concatenate([[0, 0], toxicity._CLASS[np.frombuffer(text.encode(), np.uint8)], [0]])
    n = toxicity.CLASSES
    return toxicity.CharacterModel(np.bincount((c[:-2] * n + c[1:-1]) * n + c[2:], minlength=n**3))


def test_lattice_search_equals_all_paths():
    import numpy as np

    rng = random.Random(12)
    model = character_model(rng)
    letters = [ord(c) for c in "idiotsuckaehlm"]
    pool = [*letters, *(toxicity.PAIR + c for c in letters), *(toxicity.RUN + c for c in letters), *(toxicity.AS_LEET + ord(c) for c in toxicity.LEET), toxicity.DECORATION, toxicity.SEPARATOR, toxicity.GAP, toxicity.WIDE]
    lattices = [[rng.choice(pool) for _ in range(rng.randint(1, 9))] for _ in range(150)]
    lattices += [[ord("f"), toxicity.MASK, toxicity.MASK, ord("k")], [ord("s"), toxicity.MASK, ord("i"), toxicity.MASK, ord("t")]]
    lattices += [[rng.choice(pool) for _ in range(70)], [toxicity.AS_LEET + ord("*")] * 12]  # longer than a grid, and more states than there is room for
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lattices])])
    raw, ends = model.restored(np.array([c for x in lattices for c in x]), bounds)
    for k, codes in enumerate(lattices):
        got = raw[ends[k] : ends[k + 1]].tobytes()
        assert model.restore(codes) == got or len(codes) <= 9
        if len(codes) <= 9:
            score = {t: brute.path_score(t, c, model.table, toxicity._CLASS) for t, c in sorted(brute.paths(codes, toxicity.OPTIONS), key=lambda x: x[1])}
            assert score[got] == pytest.approx(max(score.values()), abs=1e-9)


def test_spacing_and_breaks_are_in_the_lattice():
    model = character_model(random.Random(13))
    read = lambda text: toxicity.readings(text, model)
    assert "idiot" in read("you i d 1 o t") and "idiot" in read("i  d  i  o  t") and "idiot" in read("i. d. i. o. t")
    assert {"idiot", "suck"} <= set(read("i d i o t s u c k")) and {"moron", "idiot"} <= set(read("m o r o n  i d i o t"))
    assert read("asshole") == ["asshole"] and set(read("a$$hole")) >= {"asshole"} and read("mor-on") == ["moron"] and read("iiiidiot") == ["idiot"]
    assert read("a fine day") == read("") == read("1 2 3 4 5") == read("été 漢字") == []


def test_scores_equal_a_plain_scorer(spark):
    import pyarrow as pa

    from threadloom.llm.text import pieces

    rng = random.Random(14)
    rows = [(k, prose(rng, 30) + rng.choice(["", " idiot", " 1d1ot", " i d i o t", " idiotic moron"]) * (k % 3 == 0)) for k in range(900)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, 1, int(t.endswith(("idiot", "1d1ot", "t", "moron")) and i % 3 == 0)) for i, t in rows], "doc_id long, quality int, toxic int")
    tables = toxicity.fit(docs, labels)
    weight = dict(zip(tables["keys"].tolist(), tables["weights"].tolist()))
    model = toxicity.CharacterModel(tables["counts"])
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    assert weight
    for i, t in rows[:200]:
        log, seen = math.log1p(-toxicity.BASE), set()
        for w in [*("".join(c if c.isalpha() else " " for c in brute.lower(t)).split()), *toxicity.readings(t, model)]:
            if w not in seen:
                seen.add(w)
                one = next(pieces(pa.array([w]), True))[2]
                keys = [int(one.hashes[0]), *(int(one.prefixes(n)[0]) for n in toxicity.BEGINNINGS)]
                log += min(0.0, *(weight.get(k, 0.0) for k in keys))
        assert got[i] == pytest.approx(1 - math.exp(log), abs=1e-9)


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, prose(random.Random(k), 30) + (" nastyword" if k % 2 else "")) for k in range(300)]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(300)], "doc_id long, quality int, toxic int").filter(toxicity.held_out())
    out = toxicity.score_documents(documents(spark, rows), labels)
    assert {round(r.score, 9) for r in out.collect()} == {toxicity.BASE}


# -- mixing ---------------------------------------------------------------------------------------------------------------------


def test_columns_named_as_in_the_plan_are_kept(spark):
    docs = documents(spark, ODD).selectExpr("*", "n_words AS cut", "n_words AS passes", "lang AS __source", "n_chars AS left", "n_words AS place", "n_words AS tokens")
    out = mixing.mix_sources(docs)
    assert out.columns == [*docs.columns, "pass", "block"] and out.filter("NOT (cut <=> n_words AND passes <=> n_words AND __source <=> lang)").count() == 0
    assert out.select("doc_id").distinct().count() == len({i for i, _ in ODD})


def test_exponent():
    t = mixing.exponent_for_repeats(0.01, 0.5, 2.0)
    assert (0.5 / 0.01) ** (1 - t) == pytest.approx(2.0) and mixing.exponent_for_repeats(0.2, 0.3, 2.0) == 0


def test_entropy_target(spark):
    q = [0.6, 0.3, 0.05, 0.05]
    t = mixing.exponent_for_entropy(spark.createDataFrame([(x,) for x in q], "q double"), 1.2)
    z = sum(x**t for x in q)
    assert -sum(x**t / z * math.log(x**t / z) for x in q) == pytest.approx(1.2, abs=1e-6)


def test_budgets_are_met(spark):
    rng = random.Random(7)
    rows = [(k, prose(rng, rng.randint(1, 30)), ["big"] * 8 + ["mid", "small"], k) for k in range(3000)]
    docs = spark.createDataFrame([(i, t, s[i % 10]) for i, t, s, _ in rows], "doc_id long, text string, source string")
    n = {i: len(brute.words(t)) for i, t, _, _ in rows}
    size = {s: sum(n[i] for i, _, x, _ in rows if x[i % 10] == s) for s in ("big", "mid", "small")}
    out = mixing.mix_sources(docs, max_repeats=3.0)
    uses = {}
    for r in out.collect():
        uses[r.source] = uses.get(r.source, 0) + n[r.doc_id]
    assert uses["big"] == size["big"]  # the largest source once
    e = mixing.exponent_for_repeats(min(size.values()) / sum(size.values()), size["big"] / sum(size.values()), 3.0)
    for s in ("mid", "small"):
        assert uses[s] == pytest.approx(size[s] * (size["big"] / size[s]) ** (1 - e), abs=40)
    assert out.groupBy("doc_id", "pass").count().filter("count > 1").count() == 0
    half = mixing.mix_sources(docs, budget=sum(n.values()) / 2.0, exponent=1.0)
    assert sum(n[r.doc_id] for r in half.collect()) == pytest.approx(sum(n.values()) / 2, abs=100)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixing.mix_sources(docs.repartition(7), max_repeats=3.0).collect()}


# -- language model -------------------------------------------------------------------------------------------------------------


def test_gradients():
    import numpy as np

    rng = np.random.default_rng(8)
    net = lm.Network(rng.normal(size=lm.PARAMETERS) * 0.1)
    around, targets = rng.integers(0, lm._SIZE, (32, 2 * lm.REACH)), np.sort(rng.integers(0, lm._SIZE, 32))
    before = net.values.astype(float).copy()
    net.squares[:] = 0
    loss = net.step(around, targets)
    assert lm.Network(net.values).forward(around, targets)[0].mean() > loss  # a step helps
    moved = np.flatnonzero(net.values != before.astype(np.float32))
    for k in rng.choice(moved, 12):
        def at(d, k=k):
            v = before.copy()
            v[k] += d
            return float(lm.Network(v).forward(around, targets)[0].astype(float).mean())
        slope = (at(0.02) - at(-0.02)) / 0.04
        if abs(slope) > 1e-3:
            assert np.sign(slope) == np.sign(net.values[k] - before[k])  # parameters move uphill


@pytest.mark.parametrize("scale", [0.1, 40.0])  # larger parameters need the row's largest output taken off
def test_network_equals_a_loop_over_masked_places(scale):
    import numpy as np

    rng = np.random.default_rng(12)
    layout = lm.Layout(1024)
    net = lm.Network(rng.normal(size=layout.parameters) * scale, layout)
    p = {k: v.astype(float) for k, v in net.parts.items()}
    first = np.array([0, 0, 1, 3, 10, 10, 40])
    tokens = rng.integers(0, layout.size, first[-1])

    def log_share(z, k):
        z = z - z.max()
        return z[k] - math.log(np.exp(z).sum())

    expected = []
    for a, b in zip(first[:-1], first[1:]):
        text = tokens[a:b].tolist()
        for k, token in enumerate(text):
            near = [text[j] if 0 <= j < len(text) else layout.size for j in range(k - lm.REACH, k + lm.REACH + 1) if j != k]
            h = np.tanh(np.concatenate([p["embedding"][j] for j in near]) @ p["hidden"] + p["hidden_bias"])
            c, m = divmod(token, layout.group)
            expected.append(log_share(h @ p["classes"] + p["class_bias"], c) + log_share(h @ p["members"][c] + p["member_bias"][c], m))
    around, got = lm.windows(tokens, first, layout.size), np.zeros(len(tokens))
    for at in lm._batches(tokens, layout.group):
        got[at] = net.forward(around[at], tokens[at])[0]
    assert np.allclose(got, expected, rtol=1e-3, atol=1e-3)


def test_mean_of_parameter_blocks_is_weighted():
    import numpy as np

    sent = [lm._blocks({0: (np.full(64, v), n), 64: (np.arange(5.0) * v, n)}) for v, n in ((1, 1), (5, 3))]
    (out,) = lm._mean_blocks(iter(sent))
    got = {k: np.frombuffer(v, np.float32).tolist() for k, v in zip(out.column("k").to_pylist(), out.column("value").to_pylist())}
    assert got == {0: [4.0] * 64, 64: [0.0, 4.0, 8.0, 12.0, 16.0]}
    assert list(lm._mean_blocks(iter([]))) == []


def test_ordered_text_scores_higher(spark):
    rng = random.Random(9)
    phrase = "the cat sat on the mat and the dog lay by the door".split()
    def text():
        k = rng.randrange(12)
        return " ".join((phrase * 6)[k : k + 40])
    rows = [(k, text()) for k in range(600)]
    mixed = []
    for k in range(50):
        w = text().split()
        rng.shuffle(w)
        mixed.append((10_000 + k, " ".join(w)))
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, rows + mixed + [(1, ""), (2, None)])).collect()}
    fine = [r.mean_log_likelihood for i, r in got.items() if 2 < i < 10_000]
    worse = [r.mean_log_likelihood for i, r in got.items() if i >= 10_000]
    assert sum(fine) / len(fine) > sum(worse) / len(worse) + 0.3
    assert all(r.log_likelihood <= 0 for r in got.values())


def test_words_of_one_bucket_have_their_own_scores(spark):
    import numpy as np
    import pyarrow as pa

    from threadloom.llm.text import pieces

    names = [f"v{k}" for k in range(600)] + [f"rare{k}" for k in range(600)]
    bucket = dict(zip(names, (next(pieces(pa.array([" ".join(names)]), False))[2].hashes % np.uint64(lm.RARE)).tolist()))
    real, once = next((a, b) for a in names[600:] for b in names[600:] if a < b and bucket[a] == bucket[b])
    rng = random.Random(11)
    common = [names[k] for k in range(600) for _ in range(40)]
    rng.shuffle(common)
    rows = [(k, " ".join(common[k * 40 : k * 40 + 40] + [real] * (k % 30 == 0))) for k in range(600)]
    rows += [(1001, f"v1 v2 {real} v3 v4"), (1002, f"v1 v2 {once} v3 v4")]
    docs = documents(spark, rows).coalesce(1)
    got = {r.doc_id: r.log_likelihood for r in lm.score_documents(docs).collect()}
    assert got[1001] - got[1002] == pytest.approx(math.log(21), abs=1e-3)  # 21 occurrences against one
    joined = {r.doc_id: r.log_likelihood for r in lm.score_documents(docs, held=0).collect()}
    assert joined == pytest.approx(got, abs=1e-3)


def test_network_grows_with_the_corpus():
    sizes = [(lm.network_words(10**k), lm.rounds(10**k)) for k in range(3, 12)]
    assert sizes[0] == (lm.FREQUENT, lm.ROUNDS) and sizes[-1][0] >= 32 * sizes[0][0] and sizes[-1][1] > lm.ROUNDS
    assert sizes == sorted(sizes)
    layout = lm.Layout(4096)
    assert layout.classes * layout.group == layout.size


# -- pipeline -------------------------------------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from threadloom.llm.bpe import default_tokenizer

    rng = random.Random(10)
    rows = []
    for k in range(400):
        rows.append((k, prose(rng, rng.randint(20, 60)) + (" idiot moron idiot" if k % 9 == 0 else "")))
    rows += [(1000 + k, rows[k][1]) for k in range(0, 60)] + [(2000 + k, edited(rng, rows[k][1], 0.02)) for k in range(60, 120)]
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("idiot" in t)) for i, t in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    current, plain = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.saved(stage(spark, current, str(tmp_path)), "test")
        assert out.columns == docs.columns
        if name == "toxicity":
            plain = {i: t for i, t in plain.items() if "idiot" not in t}
        elif name == "exact_dedup":
            best = {t: i for i, t in sorted(plain.items())}
            plain = {i: t for i, t in plain.items() if best[t] == i}
        elif name == "near_dedup":
            groups = brute.near_groups(list(plain.items()), 5, 80)
            plain = {i: t for i, t in plain.items() if groups[i][1] == i}
        assert {(r.doc_id, r.text) for r in out.collect()} == set(plain.items())
        if name != "source_mixing":
            assert out.count() == len(plain)
        current = out
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(default_tokenizer())
    assert len(final) == current.count() and {r.doc_id for r in final} == set(plain)
    assert all(r.n_tokens == len(library.encode(plain[r.doc_id], add_special_tokens=False).ids) for r in final[:50])
    assert all(r.decoded_sha256 == hashlib.sha256(plain[r.doc_id].encode()).hexdigest() for r in final)


@pytest.mark.parametrize("rows", [ODD, []])
def test_pipeline_takes_odd_rows_and_none(spark, tmp_path, rows):
    import corpus_pipeline

    docs = documents(spark, rows).withColumnRenamed("n_words", "passes").withColumnRenamed("digest", "cut")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # Equal texts: the largest doc_id stays; "a b" and "A  B" have the same words.
    assert got == ({2, 4, 5, 6, 8, 9, 10} if rows else set())


# -- names ----------------------------------------------------------------------------------------------------------------------


def test_columns_of_any_name_pass_through(spark):
    names = ["k", "key", "row", "order", "digest", "content", "__row", "__id", "kept_id", "__t", "__g", "n_words", "text_digest", "__mixing_cut", "plan_cut", "plan_source", "Plan_Passes", "a.b", "m", "stratum"]
    docs = documents(spark, ODD[:10]).drop("n_words", "digest")
    docs = docs.select("*", *[F.concat(F.lit(f"{n}="), F.col("doc_id").cast("string")).alias(n) for n in names])
    kept = exact.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.filter("doc_id < 8").collect()) == [2, 4, 5, 6, 7]
    near, mixed = neardup.drop_near_copies(docs), mixing.mix_sources(docs)
    assert near.columns == docs.columns and near.filter("doc_id = 1").count() == 1 and near.filter("doc_id = 2").count() == 0
    assert mixed.columns == [*docs.columns, "pass", "block"]
    for out in (kept, near, mixed):
        for r in out.filter("doc_id IS NOT NULL").collect():
            assert all(r[n] == f"{n}={r.doc_id}" for n in names)
    features = quality.text_features(docs)
    assert set(quality.FEATURES) <= set(features.columns) and len(features.columns) == len(set(features.columns))
    assert all(r["__t"] == f"__t={r.doc_id}" for r in features.filter("doc_id IS NOT NULL").collect())
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs, labels, stratum="stratum").count() == docs.count()


# -- copies prove nothing -------------------------------------------------------------------------------------------------------


def test_copies_admit_no_cutoff_that_one_text_does_not(spark):
    rng = random.Random(11)
    good, bad = prose(rng, 70), " ".join(w + "$#" for w in prose(rng, 70).split())
    schema = "doc_id long, text string, lang string"
    for n, m in ((1, 1), (2000, 30)):
        rows = [(k, good, "en") for k in range(n)] + [(n + k, bad, "en") for k in range(m)]
        labels = [(i, int(i < n), 0) for i, _, _ in rows] * 2
        out = quality.judge_quality(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert out.filter("NOT kept").count() == 0


def test_levels_are_not_clamped(spark):
    """Only documents whose words are far longer than those of any good one are rejected, though good ones lie above ten characters a word."""
    rng = random.Random(12)
    word = lambda size: "".join(rng.choice("abcdefghijklmnop") for _ in range(size))
    rows = [(k, " ".join(word(40 if k % 5 == 0 else 14) for _ in range(60)), "en") for k in range(3000)]
    labels = [(k, int(k % 5 > 0), 0) for k, _, _ in rows]
    out = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r.doc_id % 5 for r in out.filter("NOT kept").collect()} == {0} and out.filter("NOT kept").count() == 600
