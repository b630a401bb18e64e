"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def substring_dedup(docs, width=35):
    ws = [(i, words(t)) for i, t in docs]
    count = Counter(tuple(w[k : k + width]) for _, w in ws for k in range(len(w) - width + 1))
    out = []
    for i, w in ws:
        gone = {p for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for p in range(k, k + width)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def shingles(text, k):
    w = words(lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_dedup(docs, k, percent):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs that share a shingle."""
    sets = [(i, shingles(t, k)) for i, t in docs]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(n)
    done = set()
    for at in by.values():
        for a in at:
            for b in at:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a][1] & sets[b][1])
                    if 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                        parent[find(b)] = find(a)
    least = {}
    for n, (i, _) in enumerate(sets):
        r = find(n)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return [(i, len(s), i if not s else least[find(n)], True if not s else i == least[find(n)]) for n, (i, s) in enumerate(sets)]


def line_dedup(docs, chars=20, least=3):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for n, (_, t) in enumerate(docs):
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                held[key(x)].add(n)
    keeper = {k: max((docs[n][0] for n in s if docs[n][0] is not None), default=None) for k, s in held.items() if len(s) >= least}
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def repeat_words(w, width=5):
    count = Counter(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return len({p for k in range(len(w) - width + 1) if count[tuple(w[k : k + width])] > 1 for p in range(k, k + width)})


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def pii(text):
    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}[kind]()

    found = sorted((m.start(), n, m.end()) for n, (k, p) in enumerate(BASE) for m in re.finditer(p, text or "") if fine(k, m[0]))
    return [sum(n == k for _, n, _ in found) for k in range(4)], ",".join(f"{BASE[n][0]}:{s}:{e}" for s, n, e in found)


def secrets(text):
    """Values after an assignment to something that is named like a secret: letters and digits, 20 or more."""
    return [(m.start(1), m.end(1)) for m in re.finditer(r"(?i)(?:token|api_key|secret|password)\s?[=:]\s?[\"']?([A-Za-z0-9]{20,})(?![A-Za-z0-9])", text or "") if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]


def em(counts, rounds=30):
    """Two classes, each labeler with a distribution of votes in each; starts at the majority, the first labeler's vote twice."""
    import numpy as np

    votes, n = np.array(list(counts)), np.array(list(counts.values()), float)
    p = np.clip(0.5 + 0.2 * (votes[:, 0] + votes.sum(1)), 0.05, 0.95)
    for _ in range(rounds):
        z = np.log((1 + (n * p).sum()) / (1 + (n * (1 - p)).sum())) + np.zeros(len(n))
        for j in range(votes.shape[1]):
            good, bad = np.array([0.5, 1.0, 1.5]), np.array([1.5, 1.0, 0.5])
            np.add.at(good, votes[:, j] + 1, n * p)
            np.add.at(bad, votes[:, j] + 1, n * (1 - p))
            z += np.log(good / good.sum())[votes[:, j] + 1] - np.log(bad / bad.sum())[votes[:, j] + 1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return {tuple(v): x for v, x in zip(votes.tolist(), p.tolist(), strict=True)}


def co_train(text, meta, y, free_text, free_meta, order, rounds):
    """The classifier's rounds on arrays: labelled rows, unlabelled rows, and the order of ties."""
    import numpy as np

    from mnemoflow.llm import op4_quality_classifier as op4

    state = op4.CoTraining(text, meta, y)
    given = [np.zeros(len(free_text), bool), np.zeros(len(free_text), bool)]
    for _ in range(rounds):
        hand = []
        for view, label, sure in state.certain(free_text, free_meta):
            at = [k for k in sorted(range(len(sure)), key=lambda k: order[k]) if sure[k] >= op4.SURE and not given[view][k]][: state.quota(label)]
            hand.append((view, label, at))
        for view, label, at in hand:
            if at:
                given[view][at] = True
                state.learn(view, label, free_text[at], free_meta[at])
        state.fit()
    return state.finish()
