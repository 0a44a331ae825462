"""Plain Python forms of what the operators compute."""

import re
from collections import Counter, defaultdict


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_lines": len(lines),
        "n_unique": len(set(words)), "n_ends": sum(text.count(c) for c in ".!?"),
    }


def plain_budgets(leaves, weights, levels, target):
    """{leaf: budget}, by filling children again and again until none is over its capacity."""

    def share(prefix, budget):
        depth = len(prefix)
        below = {k: v for k, v in leaves.items() if k[:depth] == prefix}
        if depth == len(levels):
            return {prefix: min(budget, below[prefix])}
        names = sorted({k[depth] for k in below})
        room = {n: sum(v for k, v in below.items() if k[depth] == n) for n in names}
        weight = {n: weights.get(levels[depth], {}).get(n, 1.0) for n in names}
        given, left, open_ = dict.fromkeys(names, 0.0), min(budget, sum(room.values())), [n for n in names if weight[n] > 0]
        while open_:
            line = left / sum(weight[n] for n in open_)
            full = [n for n in open_ if room[n] <= line * weight[n] + 1e-9]
            if not full:
                given.update({n: line * weight[n] for n in open_})
                break
            for n in full:
                given[n] = float(room[n])
                left -= room[n]
                open_.remove(n)
        out = {}
        for n in names:
            out.update(share((*prefix, n), given[n]))
        return out

    return share((), target)


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(rows):
    sets = {i: plain_set(t) for i, t in rows}
    inside = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            inside[g].append(i)
    shared = Counter((a, b) for ids in inside.values() for k, b in enumerate(ids) for a in ids[:k])
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}
