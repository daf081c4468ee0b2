"""Plain Python versions of what the queries return, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def fits(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def pii(docs):
    for doc_id, text in docs:
        spans = [(k, m.start(), m.end()) for k, p in KINDS.items() for m in re.finditer(p, text or "") if fits(k, m[0])]
        n = Counter(k for k, *_ in spans)
        yield {"doc_id": doc_id, **{f"n_{k}": n[k] for k in KINDS}, "base_sha256": sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))}


def removed(docs, width=13):
    first = {}
    for doc_id, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, doc_id), doc_id)
    for doc_id, text in docs:
        w = words(text)
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < doc_id for j in range(i, i + width)}
        yield {"doc_id": doc_id, "n_words": len(w), "n_removed": len(gone), "kept_sha256": sha(" ".join(x for j, x in enumerate(w) if j not in gone))}


def ascii_lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def shingles(text, width=5):
    w = words(ascii_lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(docs):
    sets = {d: shingles(t) for d, t in docs}
    by, up = defaultdict(set), {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            by[x].add(d)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for d, s in sets.items():
        for o, n in Counter(o for x in s for o in by[x] if o < d).items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                up[b] = a
    for d, s in sets.items():
        yield {"doc_id": d, "n_shingles": len(s), "component_id": root(d)}


def rules(docs):
    for doc_id, text in docs:
        w, t = words(text), text or ""
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {j for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        yield {"doc_id": doc_id, "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again), "base_failed": failed}


def leaked(docs, benchmark, width=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    items = defaultdict(set)
    for item, text in benchmark:
        w = split(text)
        k = min(width, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            items[tuple(w[i : i + k])].add(str(item))
    lengths = {len(k) for k in items}
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i : i + k])) in items:
                    hit |= set(range(i, i + k))
                    found |= items[g]
        yield {"doc_id": doc_id, "n_words": len(w), "n_hit": len(hit), "n_items": len(found), "items_sha256": sha(",".join(sorted(found))), "contaminated": bool(hit)}


def archived(pages):
    first = {}
    for page_id, html in pages:
        b = (html or "").encode("utf-8", "surrogatepass")
        first[b] = min(first.get(b, page_id), page_id)
    for page_id, html in pages:
        b = (html or "").encode("utf-8", "surrogatepass")
        again = len(b) >= 100 and first[b] != page_id
        yield {"page_id": page_id, "payload_bytes": len(b), "payload_digest": hashlib.sha256(b).hexdigest(), "record_type": "revisit" if again else "response", "refers_to": first[b] if again else None}


def tokens(docs, tokenizer):
    start = 0
    for doc_id, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        yield {"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))}
        start += len(ids)


# --- conversations, manifests, mixes ---


def damage(rows):
    """What is left of (conv_id, turn, role, text) rows."""
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            text = "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
            yield from [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)


def repair(rows, everyone):
    """All edits of every row, the cheapest for each role that the repaired rows may end with."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    full = {"s": "system", "u": "user", "a": "assistant"}
    for conv in {c for c, *_ in everyone}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in own:
            left = text.rstrip(" \t\n\x0b\f\r")
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None)
            seen.add((role, text))
        ways = {"": (0, "", [])}

        def better(found, end, way):
            if end not in found or way[:2] < found[end][:2]:
                found[end] = way

        def inserted(ways):
            found = dict(ways)
            for _ in range(3):
                for end, (cost, audit, lines) in list(found.items()):
                    for role in follows[end].replace("s", ""):
                        better(found, role, (cost + 2, audit + "I", [*lines, full[role] + ":"]))
            return found

        for (_, _, role, text), fault in zip(own, faults, strict=True):
            found = {}
            for end, (cost, audit, lines) in ways.items():
                better(found, end, (cost + 3, audit + "D", lines))
            if fault in (None, "truncated"):
                for end, (cost, audit, lines) in inserted(ways).items():
                    more = fault == "truncated"
                    if role[:1] and role[:1] in follows[end]:
                        better(found, role[0], (cost + more, audit + "K", [*lines, f"{role}:{text}"]))
                    for new in follows[end].replace("s", ""):
                        better(found, new, (cost + 2 + more, audit + "R", [*lines, f"{full[new]}:{text}"]))
            ways = found
        ends = [w for end, w in inserted(ways).items() if end in ("", "a")]
        cost, audit, lines = min(ends, key=lambda w: w[:2])
        turns = {r[1] for r in own} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        yield {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        }


def manifest(rows):
    """Of (doc_id, source, lang, n_chars, text) rows."""

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            yield run[: i % 3], run[i % 3 + 1 :]
            i //= 3

    groups = {}
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))):
        groups.setdefault(row[1], []).append(row)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in groups[s]]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, row in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            doc_id, text = row[0], row[4]
            bent = doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = leaf((*row[:4], text.replace("\n", "") if bent else text))
            for left, right in steps:
                node = h(*left, node, *right)
            yield {"doc_id": doc_id, "leaf": leaf(row), "subroot": trees[s][-1][0], "root": top[-1][0], "proof_sha256": h(*[x for left, right in steps for x in left + right]), "folded_root": node, "verified": node == top[-1][0]}


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Sources and their targets, by sharing the excess anew as long as there is any."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        found = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if found[s] > most * sizes[s]}
        if not above:
            return found | {s: most * sizes[s] for s in full}
        full |= above
