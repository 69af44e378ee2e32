"""Plain versions of the contracts over conversations, for small inputs."""

import hashlib
import re
import zlib
from functools import lru_cache

sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
NULLS = lambda x: (x is not None, x)
GAP = "\x20\x09\x0a\x0b\x0c\x0d"


def _ordered(rows):
    return sorted(rows, key=lambda r: tuple(map(NULLS, r)))


def trie(rows):
    """Rows of (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in _ordered(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = (*own.get(c - c % 100, [])[:h], *turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
        ends.setdefault(whole, []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children.get(p, [])]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        totals[p] = (sum(t[0] for t in below) if below else 1, saved + sum(t[1] for t in below))
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *totals[p],
         sha(",".join(map(str, sorted(ends.get(p, []))))))
        for p, m in members.items())


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def cheapest(turns):
    """(cost, audit, repaired) of (kind, role, text) by looking at every edit at every turn."""

    def after(state, letter):
        return {"": "s" if letter == "s" else "u" if letter == "u" else None, "s": "u" if letter == "u" else None,
                "u": "a" if letter == "a" else None, "a": "u" if letter == "u" else None}[state]

    @lru_cache(None)
    def go(i, state, inserted):
        found = []
        if i == len(turns):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            kind, role, text = turns[i]
            cost, audit, rest = go(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, rest))
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                for letter, name, price in [(role[:1], role, 0), ("u", "user", 1), ("a", "assistant", 1)]:
                    if letter in ("s", "u", "a") and after(state, letter):
                        cost, audit, rest = go(i + 1, letter, 0)
                        found.append((cost + price + more, ("R" if price else "K") + audit, ((name, text), *rest)))
        if inserted < 4:
            for letter, name in (("u", "user"), ("a", "assistant")):
                if after(state, letter):
                    cost, audit, rest = go(i, letter, inserted + 1)
                    found.append((cost + 5, "I" + audit, ((name, ""), *rest)))
        return min(found, default=(10**9, "", ()))

    return go(0, "", 0)


def faults(turns):
    seen, out = set(), []
    for _, role, text in turns:
        bare = text.strip(GAP)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((kind, role, text))
    return tuple(out)


def repairs(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)}"""
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        turns = _ordered(r[1:] for r in after if r[0] == conv)
        numbers = [t[0] for t in turns if t[0] is not None]
        found = faults(turns)
        initials = [t[1][:1] for t in turns]
        cost, audit, repaired = cheapest(found)
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
            *(sum(k == kind for k, _, _ in found) for kind in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, sha("\n".join(f"{r}:{t}" for r, t in repaired)))
    return out
