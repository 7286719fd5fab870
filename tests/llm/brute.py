"""Plain versions of what the operators compute."""

import hashlib
import math
import zlib
from collections import Counter

SPACE = " \t\n\v\f\r"


def words(text):
    out, now = [], ""
    for ch in text or "":
        if ch in SPACE:
            out, now = (out + [now] if now else out), ""
        else:
            now += ch
    return out + [now] if now else out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k=5):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def components(docs):
    """docs: (id, text) -> {id: smallest id reachable}, by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def measures(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if times[x] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def passes(text):
    n_words, word_chars, n_symbols, n_dup, n_repeat = measures(text)
    lines = sum(bool(words(x)) for x in (text or "").split("\n"))
    upper, low = (sum(a <= c <= b for c in text or "") for a, b in ("AZ", "az"))
    return bool(n_words) and 2 * n_repeat <= n_words and 10 * n_symbols <= n_words and 2 * n_dup <= lines and 2 * n_words <= word_chars <= 20 * n_words and upper <= low


def mixed(rows, weights=(3, 1, 2), share=1.5, most=2.0, buckets=64):
    """rows with doc_id, source, text -> how often each is taken: one walk along each source's order."""
    name = lambda r: str(r.doc_id) if r.doc_id is not None else md5((r.text or "").encode()) if r.text is not None else ""
    md5 = lambda b: hashlib.md5(b).hexdigest()
    hash16 = lambda t: int(md5(t.encode())[:4], 16)
    size = {r: len(words(r.text)) for r in rows}
    sources = sorted({r.source for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[r] for r in rows if r.source == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    capped, left = {}, {}
    while True:
        free = [s for s in sources if s not in capped]
        left = {s: (share * sum(total.values()) - sum(capped.values())) * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if left[s] > most * total[s]]
        if not over:
            break
        capped |= {s: most * total[s] for s in over}
    out = Counter()
    for s in sources:
        rate = (capped | left)[s] / total[s] if total[s] else 0.0
        offset = hash16("mix-" + ("null" if s is None else "s" + s)) / 65536

        def order(r):
            n = size[r]
            octave = max(1, n).bit_length() - 1
            kind = 1 + octave * 16 + ((n * 16) >> octave) % 16 if n else 0
            return kind, hash16(name(r)) % buckets, n, md5(name(r).encode()), r.doc_id or -1

        for place, r in enumerate(sorted((r for r in rows if r.source == s), key=order)):
            out[r] += min(math.floor(offset + rate * (place + 1)) - math.floor(offset + rate * place), math.ceil(rate))
    return out


def remainder(doc_id, m):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % m


def ppm_scores(docs, held_out, order=5):
    """docs: (id, text) -> for each (n_tokens, n_known, N, base, score)."""
    streams = [(i, [x.encode() for x in words(lower(t))]) for i, t in docs]
    counts, n_texts = Counter(), 0
    tries = [{} for _ in range(order + 1)]
    for i, w in streams:
        if held_out(i):
            continue
        counts.update(w)
        n_texts += 1
        s = b"\n" * order + b"".join(x + b" " for x in w) + b"\n"
        for p in range(order, len(s)):
            for k in range(order + 1):
                c = tries[k].setdefault(s[p - k : p], Counter())
                c[s[p]] += 1
    n = sum(counts.values()) + n_texts
    bottom = n + len(counts) + (n_texts > 0) + 1
    out = []
    for _, w in streams:
        base = sum(math.log10((counts[x] + 1) / bottom) for x in w) + math.log10((n_texts + 1) / bottom)
        s, score = b"\n" * order + b"".join(x + b" " for x in w) + b"\n", 0.0
        for p in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                if (c := tries[k].get(s[p - k : p])) is None:
                    continue
                left = {a: b for a, b in c.items() if a not in gone}
                total = sum(left.values())
                if s[p] in left:
                    score += math.log10((2 * left[s[p]] - 1) / (2 * total))
                    break
                if left:
                    score += math.log10(len(left) / (2 * total))
                gone |= set(c)
            else:
                score -= math.log10(256 - len(gone))
        out.append((len(w) + 1, sum(counts[x] > 0 for x in w) + (n_texts > 0), n, base, score))
    return out


def languages(docs, buckets=1 << 17, switch=6.0, uses=0.005):
    """docs: (text, lang), trained on where both are there -> for each (lang_pred, score)."""
    scripts = [(0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xCB, 1), (0xCD, 0xCF, 2), (0xD0, 0xD3, 3), (0xD4, 0xD7, 4), (0xD8, 0xDF, 5), (0xE0, 0xE1, 6), (0xE3, 0xE3, 7), (0xE4, 0xE9, 8), (0xEA, 0xED, 9), (0xF0, 0xF4, 10)]

    def letter_words(text):
        out, now = [], b""
        for b in text.lower().encode() + b" ":
            if 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80:
                now += bytes([b])
            elif now:
                out.append(now)
                now = b""
        return out

    def grams(word):
        w = b" " + word + b" "
        return [((w[i - 1] << 16 | w[i] << 8 | w[i + 1]) * 2654435761 % 2**32) >> (32 - buckets.bit_length() + 1) for i in range(1, len(w) - 1)]

    script = lambda b: next((s for low, high, s in scripts if low <= b <= high), 0)
    names = sorted({lang for text, lang in docs if text is not None and lang is not None})
    counts, written = {x: Counter() for x in names}, {x: Counter() for x in names}
    for text, lang in docs:
        if text is not None and lang is not None:
            for w in letter_words(text):
                counts[lang].update(grams(w))
                written[lang].update(s for s in map(script, w) if s)
    total = {x: sum(counts[x].values()) for x in names}
    used = {x: {s for s, n in written[x].items() if n >= uses * max(1, sum(written[x].values()))} for x in names}
    out = []
    for text, _ in docs:
        if text is None or not any(c.isalpha() for c in text):
            out.append(("und", 0.0))
            continue
        found = letter_words(text)
        best, back, open_words = {x: 0.0 for x in names}, [], []
        for t, w in enumerate(found):
            allowed = [x for x in names if max(map(script, w)) in used[x]]
            open_words.append(bool(allowed))
            now, came = {}, {}
            top = max(names, key=lambda x: best[x])  # noqa: B023
            for x in names:
                stay = best[x] >= best[top] - (switch if t else 0)
                came[x] = x if stay else top
                score = -1e9 if allowed and x not in allowed else 0.0
                if not allowed or x in allowed:
                    score = sum(math.log((counts[x][g] + 0.5) / (total[x] + 0.5 * buckets)) for g in grams(w)) if allowed else 0.0
                now[x] = (best[x] if stay else best[top] - (switch if t else 0)) + score
            best = now
            back.append(came)
        state, letters = max(names, key=lambda x: best[x]), Counter()  # noqa: B023
        for came, w, is_open in zip(reversed(back), reversed(found), reversed(open_words), strict=True):
            if is_open:
                letters[state] += len(w)
            state = came[state]
        if letters:
            lang = max(names, key=lambda x: letters[x])  # noqa: B023
            out.append((lang, letters[lang] / sum(letters.values())))
        else:
            out.append((max(names, key=lambda x: total[x]), 0.0))
    return out


def weak_quality(docs, weaklabel, rounds=200, steps=150):
    """docs: (id, text) -> for each (n_votes, posterior, score): votes, EM and gradient steps in loops. Labellers and features' buckets are the operator's."""
    texts = [t for _, t in docs]

    def measured(text):
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = measures(text)
        lines = sum(bool(words(x)) for x in (text or "").split("\n"))
        return dict(n_words=n_words, word_chars=word_chars, n_symbols=n_symbols, n_dup_lines=n_dup_lines, n_repeat_words=n_repeat_words, n_lines=lines, n_upper=sum("A" <= c <= "Z" for c in text or ""), n_lower=sum("a" <= c <= "z" for c in text or ""))

    def holds(condition, m):
        condition = condition.replace(" OR ", " or ").replace(" AND ", " and ")
        if " BETWEEN " in condition:
            value, _, bounds = condition.partition(" BETWEEN ")
            low, high = bounds.split(" and ")
            condition = f"({low}) <= ({value}) <= ({high})"
        return eval(condition, {}, m)  # noqa: S307

    votes = []
    for text in texts:
        m = measured(text)
        row = []
        for x in weaklabel.LABELLERS:
            good, bad = holds(x.good, m), holds(x.bad, m)
            row.append(1 if good and not bad else 0 if bad and not good else -1)
        votes.append(row)
    good = []
    for row in votes:
        said = [v for v in row if v >= 0]
        good.append(0.1 + 0.8 * (sum(said) / len(said) if said else 0.5))
    for _ in range(rounds):
        share = sum(good) / len(good)
        logs = [[math.log(max(1e-12, p))] * len(votes) for p in (1 - share, share)]
        for c in (0, 1):
            weight = [g if c else 1 - g for g in good]
            for k in range(len(weaklabel.LABELLERS)):
                mass = {v: 1 + sum(w for w, row in zip(weight, votes, strict=True) if row[k] == v) for v in (-1, 0, 1)}
                logs[c] = [x + math.log(mass[row[k]] / sum(mass.values())) for x, row in zip(logs[c], votes, strict=True)]
        good = [1 / (1 + math.exp(max(-50, min(50, a - b)))) for a, b in zip(*logs, strict=True)]

    def features(text):
        w = (text or "").encode().split()
        out = Counter()
        for x in w:
            for b in weaklabel._word_buckets(x):
                out[b] += 1 / len(w)
        for b in weaklabel._text_buckets(w):
            out[b] += 1.0
        return out

    chosen = [i for i, doc in enumerate(docs) if doc not in docs[:i]]
    found = {i: features(texts[i]) for i in range(len(docs))}
    mass = sum(good[i] for i in chosen), sum(1 - good[i] for i in chosen)
    weights, squares, bias, own = Counter(), {}, 0.0, 1e-8
    for _ in range(steps):
        gradient, slope = Counter({b: 1e-5 * w for b, w in weights.items()}), 0.0
        for i in chosen:
            weigh = good[i] / mass[0] + (1 - good[i]) / mass[1]
            margin = sum(weights[b] * v for b, v in found[i].items()) + bias
            error = weigh / (1 + math.exp(-margin)) - good[i] / mass[0]
            slope += error
            for b, v in found[i].items():
                gradient[b] += v * error
        for b, g in gradient.items():
            squares[b] = squares.get(b, 1e-8) + g * g
            weights[b] -= 0.5 * g / math.sqrt(squares[b])
        own += slope**2
        bias -= 0.5 * slope / math.sqrt(own)
    score = [1 / (1 + math.exp(-(sum(weights[b] * v for b, v in found[i].items()) + bias))) for i in range(len(docs))]
    return [(sum(v >= 0 for v in row), g, x) for row, g, x in zip(votes, good, score, strict=True)]
