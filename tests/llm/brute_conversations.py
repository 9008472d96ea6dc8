"""Plain repair of conversations, one row at a time, to hold the operator against."""

import hashlib
import re
import zlib

WORD = r"[^\x20\x09-\x0D]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = re.findall(WORD, text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Least (cost, audit) and the texts, trying every edit at every row and keeping the best per state."""
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for q, (c, a, t) in list(best.items()):
                to = step[q]
                way = (c + 5, a + "I", t + (("user" if to == "u" else "assistant") + ":",))
                if to not in best or way[:2] < best[to][:2]:
                    best[to] = way
        return best

    for (_, _, role, text), fault in zip(rows, found):
        new = {}

        def offer(q, way):
            if q not in new or way[:2] < new[q][:2]:
                new[q] = way

        for q, (c, a, t) in inserts(best).items():
            offer(q, (c + 2, a + "D", t))
            if fault in ("blank", "duplicate"):
                continue
            more = 5 if fault == "truncated" else 0
            to = step[q]
            offer(to, (c + more + 1, a + "R", t + (("user" if to == "u" else "assistant") + ":" + text,)))
            if role[:1] == to or (role[:1] == "s" and q == ""):
                offer(role[:1], (c + more, a + "K", t + (role + ":" + text,)))
        best = new
    return min(inserts(best)[q] for q in ("", "a") if q in best)


def report(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, rs in groups.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns = [r[1] for r in rs if r[1] is not None]
        found = faults(rs)
        cost, audit, texts = cheapest(rs, found)
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(rs, rs[1:])]
        out[conv] = dict(
            gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
            illegal=sum(p not in ("su", "ua", "au") for p in pairs), cost=cost, audit=audit,
            repaired_sha256=hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out
