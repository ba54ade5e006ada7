"""Plain restatements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def licenses(text: str | None) -> tuple:
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    at, labels = [], set()
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        here = [i for i in range(len(ws)) if ws[i : i + len(p)] == p]
        at += here
        labels |= {label} if here else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def quality(text: str | None) -> tuple:
    ws = words(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(ws) - 7):
        at[tuple(ws[i : i + 8])].append(i)
    inside = {j for found in at.values() if len(found) > 1 for i in found for j in range(i, i + 8)}
    failed = len(ws) < 20 or 100 * len(inside) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), failed


def shingles(text: str | None, k: int = 5) -> set:
    ws = words(lower(text))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


def jaccard_components(docs: dict[int, str | None]) -> dict[int, tuple[int, int, int]]:
    sets = {d: shingles(t) for d, t in docs.items()}
    by, inv = defaultdict(set), defaultdict(list)
    for d, s in sets.items():
        for x in s:
            inv[x].append(d)
    for d, s in sets.items():
        n = defaultdict(int)
        for x in s:
            for o in inv[x]:
                n[o] += 1
        for o, c in n.items():
            if o != d and 100 * c >= 75 * (len(s) + len(sets[o]) - c):
                by[d].add(o)
    out = {}
    for d in sorted(docs):
        if d in out:
            continue
        todo, seen = [d], {d}
        while todo:
            for o in by[todo.pop()] - seen:
                seen.add(o)
                todo.append(o)
        for o in seen:
            out[o] = d
    return {d: (len(sets[d]), out[d], len(by[d])) for d in docs}


def repeated_windows(docs: dict[int, str | None], k: int = 35) -> dict[int, tuple[int, int, str]]:
    ws = {d: words(t) for d, t in docs.items()}
    n = defaultdict(int)
    for w in ws.values():
        for i in range(len(w) - k + 1):
            n[tuple(w[i : i + k])] += 1
    out = {}
    for d, w in ws.items():
        gone = set()
        for i in range(len(w) - k + 1):
            if n[tuple(w[i : i + k])] > 1:
                gone.update(range(i, i + k))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())
    return out


def repeated_bytes(docs: dict[int, str | None], k: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for d in sorted(docs):
        b = (docs[d] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            x = b[i : i + k]
            if x in seen:
                gone[i : i + k] = b"\1" * k
            seen.add(x)
        runs = len(re.findall(b"\1+", bytes(gone)))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def url(u: str | None) -> tuple:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (lower(m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def bpe(text: str | None, tokenizer) -> tuple[int, str, str]:
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def features(text: str | None, low: int, high: int) -> list[bytes]:
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return [" ".join(ws[i : i + n]).encode() for n in range(low, high + 1) for i in range(len(ws) - n + 1)]


def resample(docs: list[tuple], target: list, low: int = 1, high: int = 1, buckets: int = 10_000, least: int = 20, percent: int = 10) -> list[tuple]:
    """Rows of docs (doc_id, text) as (doc_id, n_features, weight, score, rank)."""
    import math
    import zlib

    own = [[zlib.crc32(f) % buckets for f in features(t, low, high)] for _, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for n, found in ((s, own), (t, [[zlib.crc32(f) % buckets for f in features(x, low, high)] for x in target])):
        for b in (b for x in found for b in x):
            n[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)] if any(own) else []
    out = []
    for (i, text), found in zip(docs, own, strict=True):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(features(text, 1, 1))))
    able = sorted((k for k, x in enumerate(out) if x[4] >= least), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    rank = {k: r for r, k in enumerate(able[: len(able) * percent // 100], 1)}
    return [(*x[:4], rank.get(k)) for k, x in enumerate(out)]


def cobucket(parent: list[dict], child: list[dict], key: str, other: str, buckets: int, salt: str) -> dict:
    """(side, bucket) of each final file: rows in order, rows of each starting file, rows of the join, and the starting file that stays."""
    import zlib
    from collections import Counter

    home = lambda r: buckets + 1 if r[key] is None else zlib.crc32(f"{salt}{r[key]}".encode()) % buckets
    known = Counter(r[key] for r in parent if r[key] is not None)
    first = (lambda r: home(r) - (home(r) % 4 == 1), lambda r: 0 if r[other] is None else zlib.crc32(str(r[other]).encode()) % buckets)
    last = (home, lambda r: buckets if r[key] is not None and r[key] not in known else home(r))
    value = lambda v: (v is not None, v.encode() if isinstance(v, str) else 0 if v is None else v)
    out = {}
    for side, rows in enumerate((parent, child)):
        began, ended = defaultdict(Counter), defaultdict(list)
        for r in rows:
            began[first[side](r)][last[side](r)] += 1
            ended[last[side](r)].append(r)
        for b, found in ended.items():
            found.sort(key=lambda r: [value(v) for k, v in r.items() if k != key])
            found.sort(key=lambda r: (r[key] is None, r[key] or 0), reverse=True)
            of = {s: n[b] for s, n in began.items() if n[b]}
            stays = next((s for s in of if len(of) == 1 and len(began[s]) == 1), None)
            out[side, b] = (found, of, stays)
    joined = {b: sum(known[r[key]] for r in found) for (side, b), (found, _, _) in out.items() if side == 1 and b < buckets}
    return {(side, b): (found, of, stays, joined.get(b, 0)) for (side, b), (found, of, stays) in out.items()}
