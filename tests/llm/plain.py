"""Plain versions of the operators, one text at a time, to hold the Spark ones against."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

BLANKS = " \t\n\x0b\x0c\r"


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text: str) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def line_dedup(docs, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    key = lambda line: lower(line.strip(BLANKS))
    for doc, text in docs:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(h := holders[key(x)]) >= min_docs and doc != max(h, key=lambda d: (d is not None, d or 0)))]
        out.append((doc, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def edited(docs):
    """doc_id -> edited text; ids differ."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for (doc, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        text, following = text or "", following or ""
        out[doc] = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    return out


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_secrets(text: str):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    spans.sort()
    kinds = ["assign", "access", "hex"]
    return [sum(k == n for _, k, _ in spans) for n in range(3)], sha(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))


def tokenizer(name: str) -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def packed_ids(ids) -> bytes:
    return b"".join(int(i).to_bytes(4, "little") for i in ids)


def base_scores(docs):
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    counts = Counter()
    for doc, text in docs:
        if not held(doc):
            counts.update([*words(text or ""), None])
    import math

    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for doc, text in docs:
        own = [*words(text or ""), None]
        out[doc] = (held(doc), len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own))
    return out


def simhash(text: str) -> int:
    w = words(text or "")
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=3):
    prints = [(d, simhash(t)) for d, t in docs]
    distinct = sorted({p for _, p in prints})
    parent = {p: p for p in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[root(a)] = root(b)
    low = {}
    for d, p in prints:
        if d is not None:
            low[root(p)] = min(low.get(root(p), d), d)
    return sorted(((d, f"{p:016x}", low.get(root(p))) for d, p in prints), key=str)


def exact(docs):
    groups = defaultdict(list)
    for doc, text in docs:
        groups[lower(text or "")].append(doc)
    out = []
    for doc, text in docs:
        own = groups[lower(text or "")]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc, keep, len(own), doc == keep, sha(lower(text or ""))))
    return sorted(out, key=str)


def trie(rows, family=20, heads=4):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of (conv, turn, role, text)."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        convs[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), (r, x)))
    convs = {c: [turn for _, _, turn in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, v in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % heads
        built[c] = (convs.get(c - c % family, [])[:h] if c is not None else []) + v[h:]
    members, children, leaves, saved = defaultdict(list), defaultdict(list), {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * (len(words(k[-1][1])) if k else 0)
    low = lambda cs: min((c for c in cs if c is not None), default=None)
    out = []
    for k, cs in members.items():
        ends = sorted((c for c in cs if len(built[c]) == len(k)), key=lambda c: (c is not None, c or 0))
        ends = ",".join("" if c is None else str(c) for c in ends)
        out.append((low(cs), len(k), low(members[k[:-1]]) if k else None, len(cs), len(children[k]), leaves[k], saved[k], sha(ends)))
    return sorted(out, key=str)


def variants(rows, min_chars=7, min_count=2, ratio=10, every=31):
    """word -> (form, root, n, n_near, form_n)"""
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= min_count and len(w) >= min_chars}
    letters, near = sorted(set("".join(n))), {}
    for w in n:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters}
        near[w] = ((edits | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}) & n.keys()) - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= ratio * n[w] else None for w, b in best.items()}
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] is not None else None)
    return out


def fused_languages(rows, model, temper, trust, parent_rows, least, foreign):
    """(language, confidence, kept) of each row (text, declared, host) by Bayes' rule, one row at a time; ``model`` as fitted."""
    import math

    known, log, levels = model

    def grams(text):
        letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
        raw = f" {letters} ".encode() if letters else b""
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 & 0xFFFFFFFF) >> 16 for i in range(len(raw) - 2)]

    def softmax(values):
        powers = [math.exp(v - max(values)) for v in values]
        return [p / sum(powers) for p in powers]

    def parts(host):
        labels = host.split(".")
        return (".".join(labels[-2:]), labels[-1]) if len(labels) > 1 else (host, "")

    seen = []
    for text, declared, host in rows:
        own = grams(text)
        evidence = [temper * sum(float(log[k, g]) for g in own) for k in range(len(known))]
        host = (host or "").lower()
        seen.append((len(own), evidence, softmax(evidence), (host, *parts(host)), (declared or "").split("-")[0].lower()))
    sums = defaultdict(lambda: [0.0] * (len(known) + 1))
    for n, _, soft, place, _ in seen:
        if n:
            for level in (place, place[1:], place[2:], ()):
                for k, s in enumerate([*soft, 1.0]):
                    sums[level][k] += s
    every = [(sums[()][k] + 1) / (sums[()][-1] + len(known)) for k in range(len(known))]
    smooth = lambda level, parent: [(sums[level][k] + parent_rows * parent[k]) / (sums[level][-1] + parent_rows) for k in range(len(known))]
    out = []
    for n, evidence, soft, place, declared in seen:
        parent = smooth(place[1:], smooth(place[2:], every))
        own = 1 if n else 0
        prior = [math.log((max(sums[place][k] - soft[k] * own, 0) + parent_rows * parent[k]) / (sums[place][-1] - own + parent_rows)) for k in range(len(known))]
        said = [0.0 if declared not in known else math.log(trust if c == declared else (1 - trust) / max(1, len(known) - 1)) for c in known]
        posterior = softmax([e + p + s for e, p, s in zip(evidence, prior, said, strict=True)])
        at = posterior.index(max(posterior))
        best = posterior[at] / (1 + math.exp(min(700, -(evidence[at] - temper * n * levels[at]))) * foreign / (1 - foreign))
        out.append((known[at], best, best >= least) if n else ("und", 0.0, False))
    return out
