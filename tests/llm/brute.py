"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
from collections import defaultdict
from itertools import combinations


def words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).encode().split()


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def groups(docs, n, percent):
    """doc_id -> (set size, smallest id reachable); docs is a list of (id, text) with distinct ids."""
    sets = {i: shingles(t, n) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, common = defaultdict(list), defaultdict(int)
    for i, s in sets.items():
        for e in s:
            for j in holders[e]:
                common[j, i] += 1
            holders[e].append(i)
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def without_repeats(docs, length=50):
    """(id, bytes, removed, spans, digest) of each document."""
    first = {}
    raws = [(i, (t or "").encode()) for i, t in docs]
    for i, b in raws:
        for s in range(len(b) - length + 1):
            k = b[s : s + length]
            first[k] = min(first.get(k, i), i)
    out = []
    for i, b in raws:
        keep = [True] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                keep[s : s + length] = [False] * length
        spans = sum(1 for k, x in enumerate(keep) if not x and (k == 0 or keep[k - 1]))
        left = bytes(c for c, k in zip(b, keep) if k)
        out.append((i, len(b), len(b) - len(left), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out)


def longest_chain(pairs, number):
    """Most different places of (place, own, item's, kinds) whose slots all agree, over all subsets."""

    def agree(some):
        said = {(kind, theirs[8 * k : 8 * k + 8], own[8 * k : 8 * k + 8]) for _, own, theirs, kinds in some for k, kind in enumerate(kinds)}
        return all(a[:2] != b[:2] and (a[0] == number or a[::2] != b[::2]) for a, b in combinations(said, 2))

    return max(len({p[0] for p in some}) for n in range(len(pairs) + 1) for some in combinations(pairs, n) if agree(some))


def pu_risk(p, u, w, prior, decay):
    """The non-negative risk of positives p and unlabelled u under weights w (the last is the bias), with its penalty."""
    score = lambda x: sum(a * b for a, b in zip(x, w)) + w[-1]
    loss = lambda z: math.log1p(math.exp(-z)) if z > -30 else -z
    up = sum(loss(score(x)) for x in p) / len(p)
    down = sum(loss(-score(x)) for x in u) / len(u) - prior * sum(loss(-score(x)) for x in p) / len(p)
    return prior * up + max(0.0, down) + decay / 2 * sum(x * x for x in w[:-1])


def codes(rows, parts, entries, rounds, scale):
    """The codebooks, and (id, code, error) of each (id, vector, label)."""
    ints = sorted((r[0], [math.floor(scale * x) for x in r[1]], tuple(r[1])) for r in rows)
    ints = sorted(ints, key=lambda r: (r[0], r[2]))
    d = len(ints[0][1]) // parts
    cut = [[v[p * d : p * d + d] for _, v, _ in ints] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = defaultdict(list)
            for x in cut[p]:
                of[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(of[i]) for c in zip(*of[i])] if of[i] else e for i, e in enumerate(books[p])]
    out = []
    for k, (i, _, _) in enumerate(ints):
        near = [nearest(cut[p][k], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{n:02x}" for _, n in near), sum(x for x, _ in near)))
    return books, out


def collocations(docs, least, percent, best):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text)."""
    f, total = defaultdict(int), defaultdict(int)
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 6):
                for i in range(len(w) - n + 1):
                    f[lang, tuple(w[i : i + n])] += 1
    often = {k: a for k, a in f.items() if a >= least}
    inner = defaultdict(int)
    for (lang, w), a in often.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                inner[lang, w[i : i + n]] = max(inner[lang, w[i : i + n]], a)
    out = defaultdict(list)
    for (lang, w), a in often.items():
        if len(w) > 1 and not (inner[lang, w] and 100 * inner[lang, w] >= percent * a):
            cuts = [(1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:best], 1))


def without_passages(docs, window):
    """(id, words, removed, digest) of each document."""
    first = {}
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in docs]
    for i, w in texts:
        for s in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, w in texts:
        keep = [True] * len(w)
        for s in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[s : s + window])] < (i, s):
                keep[s : s + window] = [False] * window
        left = [x for x, k in zip(w, keep) if k]
        out.append((str(i), len(w), len(w) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out)


def toxic_clauses(text, classes, arcs, span=3):
    """Scores of the clauses that hold a match, read word by word; ``classes`` has the words of each class, ``arcs`` weights of words and beginnings (``w*``)."""
    words = re.sub("[\"“”„«»]", " \x01 ", text).replace("\n", " \x00 ").split()
    clauses, own = [], []
    for w in words:
        core = w.strip("".join(chr(b) for b in range(33, 127) if not chr(b).isalnum())) if w != "\x01" else w
        core = "".join(c.lower() if "A" <= c <= "Z" else c for c in core).replace("’", "'")
        kind, weight = next(((k, 0.0) for k, names in classes.items() if core in names and k != "insult"), ("other", 0.0))
        if core in classes["insult"]:
            kind, weight = "insult", 3.0
        if core in arcs and kind in ("other", "insult"):
            kind, weight = "insult", arcs[core]
        if kind == "other":
            for n in (4, 5, 6, 7, 8):
                if len(core.encode()) >= n and core[:n] + "*" in arcs:
                    kind, weight = "insult", arcs[core[:n] + "*"]
        own.append(("quote", 0.0) if w == "\x01" else (kind, min(weight, 8.0)))
        if w == "\x00" or w[-1] in ".!?;:,":
            clauses.append(own)
            own = []
    clauses.append(own)
    scores = []
    for own in clauses:
        if not any(k in ("insult", "harm", "doom") for k, _ in own):
            continue
        total, target, denied, speech, quoted, near, seen, left = 0.0, False, 0, False, False, 0, None, 0
        for kind, weight in own:  # near: -1 right behind a target, else words left behind target and verb to be
            factor = (1.2 if target else 1.0) * (0.3 if denied else 1.0) * (0.4 if speech or quoted else 1.0)
            if kind == "insult":
                total += factor * weight * (1.5 if near else 1.0)
            if kind == "target":
                total += 6.0 * factor * {"harm": 0.6, "meant": 1.0}.get(seen, 0.0)
            if kind == "doom" and seen == "both":
                total += 6.0 * factor * 0.8
            was = near
            near = -1 if kind == "target" else span if kind == "be" and was else was - 1 if was > 0 and kind in ("other", "negation", "insult") else 0
            if kind == "target":
                seen, left = "target", span
            elif kind == "intent":
                seen, left = ("both" if seen in ("target", "both") else "intent"), span
            elif kind == "harm":
                seen, left = ("meant" if seen in ("intent", "both") else "harm"), span
            elif kind in ("doom", "object"):
                seen = None
            else:
                left -= 1
                seen = seen if left > 0 else None
            target = target or kind == "target"
            denied = (0 if denied else span + 1) if kind == "negation" else max(0, denied - 1)
            if kind == "quote":
                quoted, speech = not quoted, False
            elif kind == "report" and not quoted:
                speech = True
        if total:
            scores.append(total)
    return scores, len(words)
