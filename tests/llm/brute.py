"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict


def components(nodes, links):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in nodes}


def jaccard(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    label = components(ids, links)
    return {i: (len(sets[i]), label[i]) for i in ids}


def repeats(rows, window):
    seen, out = {}, {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            k = raw[p : p + window]
            if k in seen:
                covered[p : p + window] = b"\1" * window
            else:
                seen[k] = 1
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        runs = sum(c and not (j and covered[j - 1]) for j, c in enumerate(covered))
        out[i] = (len(raw), sum(covered), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def near_vectors(rows, threshold):
    import numpy as np

    ok = {}
    for i, v, label in rows:
        if label is not None and v and None not in v and np.isfinite(v).all() and any(v):
            a = np.array(v, float)
            ok[i] = (label, a / np.linalg.norm(a))
    links = defaultdict(set)
    ids = sorted(ok)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= threshold:
                links[a].add(b)
                links[b].add(a)
    label = components([r[0] for r in rows], [(a, b) for a in links for b in links[a]])
    return {r[0]: (len(links[r[0]]), label[r[0]]) for r in rows}


def token_starts(rows, path, end_id):
    import numpy as np
    from tokenizers import Tokenizer

    library, out, start = Tokenizer.from_file(path), {}, 0
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end_id]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        start += len(ids)
    return out


def aligned(rows, first, second):
    """By the libraries on whole texts: (n_a, n_b, n_groups, n_links, n_best, count_sum, hash) of each row."""
    import sentencepiece
    from tokenizers import Tokenizer

    from gazeflow.llm.tokens import byte_symbols

    a, b, back = Tokenizer.from_file(first), sentencepiece.SentencePieceProcessor(model_file=second), {s: n for n, s in byte_symbols().items()}
    a.encode_special_tokens = True
    found, held = [], Counter()
    for i, t in rows:
        ids, texts = ([], []), ([], [])
        if t:
            ids = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
            texts = [bytes(back[c] for c in a.id_to_token(x)) for x in ids[0]], [bytes([int(b.id_to_piece(x)[3:5], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("\u2581", " ").encode() for x in ids[1]]
            if {b"".join(x) for x in texts} != {(" " + t).encode()}:
                ids, texts = ([], []), ([], [])
        ends = [list(itertools.accumulate(map(len, x))) for x in texts]
        both = set(ends[0]) & set(ends[1])
        groups = [[[]], [[]]]
        for side, own, at in zip(groups, ids, ends):
            for x, e in zip(own, at):
                side[-1].append(x)
                if e in both:
                    side.append([])
        groups = list(zip(groups[0][:-1], groups[1][:-1]))
        links = Counter(p for x, y in groups for p in itertools.product(x, y))
        held.update(links.keys())
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        found.append((i, len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    top = {}
    for (x, _), n in held.items():
        top[x] = max(n, top.get(x, 0))
    return [(i, na, nb, g, l.total(), sum(k for p, k in l.items() if held[p] == top[p[0]]), sum(k * held[p] for p, k in l.items()), h) for i, na, nb, g, l, h in found]


def spellings(rows, shortest, least, factor):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}

    def near(u, v):
        if len(u) == len(v):
            return sum(x != y for x, y in zip(u, v)) == 1
        u, v = sorted((u, v), key=len)
        return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))

    close = {w: [v for v in counts if v != w and near(v, w)] for w in counts}
    best = {w: min(c, key=lambda v: (-counts[v], v)) for w, c in close.items() if c}
    form = {w: v for w, v in best.items() if counts[v] >= factor * counts[w]}
    out = {}
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, counts[w], len(close[w]), counts[form[w]] if w in form else None)
    return out
