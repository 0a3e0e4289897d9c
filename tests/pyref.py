"""The match of one text and one query in plain loops, after the rules. For tests only."""

import itertools

import regex

from tierseek.functions import fold as T

word = regex.compile(r"[\p{L}\p{N}_]").fullmatch
LITERAL = ("exact", "normalised-exact", "prefix", "boundary-exact", "boundary", "multi-word", "acronym", "contains")


def opens(text, i):
    return i == 0 or not word(text[i - 1])


def closes(text, end):
    return end + 1 >= len(text) or not word(text[end + 1])


def places(text, q):
    return [i for i in range(len(text) - len(q) + 1) if text.startswith(q, i)]


def literal(field, norm, raw, q, acronym):
    words = regex.findall(r"[\p{L}\p{N}_]+", q)
    if field == raw:
        return 0.0, "exact", [(0, len(field) - 1)]
    if norm == q:
        return 0.1, "normalised-exact", [(0, len(norm) - 1)]
    if norm.startswith(q):
        return 0.5, "prefix", [(0, len(q) - 1)]
    for text, x, score, tier in ((field, raw, 0.9, "boundary-exact"), (norm, q, 1.0, "boundary")):
        at = [i for i in places(text, x) if opens(text, i)]
        if at:
            return score, tier, [(at[0], at[0] + len(x) - 1)]
    if len(words) > 1:
        found = [[i for i in places(norm, w) if opens(norm, i) and closes(norm, i + len(w) - 1)] for w in words]
        if all(found):
            return 1.5, "multi-word", sorted((f[0], f[0] + len(w) - 1) for f, w in zip(found, words))
    if acronym and len(words) == 1 and len(q) >= 2:
        starts = [m.start() for m in regex.finditer(r"[\p{L}\p{N}_]+(?:'[\p{L}\p{N}_]+)*", norm)]
        at = "".join(norm[i] for i in starts).find(q)
        if at >= 0:
            return 1.8, "acronym", [(i, i) for i in starts[at : at + len(q)]]
    at = norm.find(q)
    return (2.0, "contains", [(at, at + len(q) - 1)]) if at >= 0 else None


def chain(norm, q):
    def admissible(k, start):
        run = q[k : k + 3]
        return [i for i in range(start, len(norm)) if norm[i] == q[k] and (opens(norm, i) or norm.startswith(run, i))]

    best = None
    for first in admissible(0, 0)[:4]:
        chunks = [[first, first]]
        for k in range(1, len(q)):
            end = chunks[-1][1]
            if end + 1 < len(norm) and norm[end + 1] == q[k]:
                chunks[-1][1] += 1
            elif at := admissible(k, end + 1):
                chunks.append([at[0], at[0]])
            else:
                break
        else:
            if len(q) / (chunks[-1][1] - chunks[0][0] + 1) >= 0.18:
                price = 2.0
                for a, b in chunks:
                    price += (0.2 if closes(norm, b) else 0.4) if opens(norm, a) else 0.8 if b - a >= 2 else 1.6
                if best is None or price < best[0]:
                    best = price, [tuple(c) for c in chunks]
    return best


def classes(text):
    return {c if "a" <= c <= "z" else ("digit", ord(c) % 4) if "0" <= c <= "9" else ("other", ord(c) % 2) for c in text if "a" <= c <= "z" or "0" <= c <= "9" or ord(c) > 127}


def match(text, query, acronym=False):
    """(score, tier, corrected, ranges) or None."""
    if text is None:
        return None
    shown = T.unicodedata.normalize("NFC", text)
    field, lead = T.trim_str(shown), len(shown) - len(shown.lstrip(T.BLANK))
    norm, raw, q = T.fold_str(text), T.trim_str(query), T.fold_str(query)
    if not q:
        return None
    words = regex.findall(r"[\p{L}\p{N}_]+", q)
    longest = len(q) if len(words) == 1 else max(map(len, words), default=0)
    out = []
    hit = literal(field, norm, raw, q, acronym)
    if hit:
        out.append((hit[0], hit[1], None, hit[2]))
    elif len(classes(q) - classes(norm)) <= (longest >= 5):
        found = chain(norm, q)
        tried = []
        if found and len(q) >= 4 and len(found[1]) == 2 and found[1][1][0] == found[1][0][1] + 2 and word(norm[found[1][0][1] + 1]):
            (a, b), (_, d) = found[1]
            k = b - a + 1
            whole = norm[a : d + 1]
            tried.append((whole, raw[:k] + norm[b + 1] + raw[k:] if len(raw) == len(q) else whole))
        absent = [w for w in words if w not in norm]
        subject = q if len(words) <= 1 else absent[0] if len(absent) == 1 else ""
        if len(words) > 0 and longest >= 4 and len(subject) >= 4:
            at = 0
            for w in words if len(words) > 1 else ():
                at = q.index(w, at)
                if w == subject:
                    break
                at += len(w)
            edits = [lambda s, i=i: s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(subject) - 1) if subject[i] != subject[i + 1]]
            if len(subject) >= (5 if len(norm) <= 64 else 6 if len(norm) <= 1024 else 7):
                edits += [lambda s, i=i: s[:i] + s[i + 1 :] for i in range(len(subject))]
                windows = [(norm[i : i + len(subject)], [j for j in range(len(subject)) if norm[i + j] != subject[j]]) for i in range(len(norm) - len(subject) + 1)]
                one = [(w, bad[0]) for w, bad in windows if len(bad) == 1]
                for w, j in [x for x in one if x[1] >= len(subject) // 2] + [x for x in one if x[1] < len(subject) // 2]:
                    edits.append(lambda s, w=w, j=j: s[:j] + w[j] + s[j + 1 :])
            for edit in edits:
                fixed = edit(subject)
                if fixed in norm:
                    full = q[:at] + fixed + q[at + len(subject) :]
                    tried.append((full, raw[:at] + edit(raw[at : at + len(subject)]) + raw[at + len(subject) :] if len(raw) == len(q) else full))
        for full, shown_as in tried:
            hit = literal(field, norm, shown_as, full, acronym)
            if hit:
                out.append((hit[0] + 2.1, "corrected", shown_as, hit[2]))
        if found:
            out.append((found[0], "fuzzy", None, found[1]))
    if not out:
        return None
    score, tier, corrected, ranges = min(out, key=lambda m: round(m[0], 9))
    return score, tier, corrected, [(a + lead, b + lead) for a, b in ranges]
