"""Alignment of two tokenizers as defined, text by text, in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict


def byte_table():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def alignments(texts, path_a, path_b):
    """For each text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    chars = byte_table()
    out, links = [], []
    for t in texts:
        ids_a = a.encode(" " + t, add_special_tokens=False).ids if t else []
        ids_b = b.encode(t) if t else []
        raw_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = (" " + (t or "")).encode()
        if not t or b"".join(raw_a) != want or b"".join(raw_b) != want:
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        spans = []
        for raw in (raw_a, raw_b):
            at, found = 0, []
            for x in raw:
                found.append((at, at + len(x)))
                at += len(x)
            spans.append(found)
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, place = [], [0, 0]
        for cut in shared:
            sides = []
            for side, ids in enumerate((ids_a, ids_b)):
                since = place[side]
                while place[side] < len(ids) and spans[side][place[side]][1] <= cut:
                    place[side] += 1
                sides.append(",".join(map(str, ids[since : place[side]])))
            groups.append("|".join(sides))
        pairs, j = [], 0
        for i, (s, e) in zip(ids_a, spans[0]):
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(ids_b) and spans[1][k][0] < e:
                pairs.append((i, ids_b[k]))
                k += 1
        out.append((len(ids_a), len(ids_b), len(groups), len(pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(pairs)
    count = Counter(p for x in links for p in set(x))
    most = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*x[:4], sum(count[p] == most[p[0]] for p in y), sum(count[p] for p in y), x[4]) for x, y in zip(out, links)]
