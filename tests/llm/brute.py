"""Brute-force versions of the operators, over plain Python rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b).hexdigest()


def byte_repeats(rows, size=100):
    """rows: (doc_id, text); a list in the rows' order. Null ids sort first;
    equal (id, text) rows are one document."""
    docs = sorted({((d is not None, d or 0), d, (t or "").encode()) for d, t in rows})
    seen, cut = set(), {}
    for _, d, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            if w in seen:
                gone[i:i + size] = b"\1" * size
            seen.add(w)
        rest = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        cut[d, b] = (d, len(b), sum(gone), spans, sha(rest), rest)
    return [cut[d, (t or "").encode()] for d, t in rows]


def word_repeats(rows, size=35):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = Counter(tuple(w[i:i + size]) for _, w in docs for i in range(len(w) - size + 1))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i:i + size])] > 1:
                gone[i:i + size] = [True] * size
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())))
    return out


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(ids, linked):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)), key=lambda v: (v is not None, v or 0))
        label[y] = x
    return {i: find(i) for i in ids}


def smallest_ids(ids, linked):
    """Per row: the smallest id (null first) among the rows that links reach;
    ``linked`` holds pairs of row numbers, as rows may share ids."""
    label = components(range(len(ids)), linked)
    low = {}
    for k, i in enumerate(ids):
        low[label[k]] = min(low.get(label[k], i), i, key=lambda v: (v is not None, v or 0))
    return [low[label[k]] for k in range(len(ids))]


def jaccard(rows, percent=80):
    sets = [(d, shingles(t)) for d, t in rows]
    links = []
    for i, (a, s) in enumerate(sets):
        for j, (b, o) in enumerate(sets[:i]):
            common = len(s & o)
            if common and 100 * common >= percent * len(s | o):
                links.append((i, j))
    return [(d, len(s), c) for (d, s), c in zip(sets, smallest_ids([d for d, _ in sets], links))]


def pieces_ok(pieces, ids_of, capacity=1024):
    """Pieces cover each document's ids once and fill sequences without a gap;
    returns the padding."""
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == ids_of.keys()
    for d, ids in ids_of.items():
        at, raw = 0, np.array(ids, "<u4")
        for p in sorted(by_doc[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(raw[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for s in by_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding
