"""Numpy code that runs on executors over Arrow batches.  Pickled by value: executors need no copy of this package."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

from pyspark import TaskContext, cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
SHINGLE, PREFIX_SHARE, LONG_LIST, CHUNK, PAIRS = 5, 0.3, 64, 256, 2_000_000


def hash_cache():
    """bytes -> 64-bit hash, remembered per task; emptied when it gets large."""
    import xxhash

    class Cache(dict):
        def __missing__(self, word):
            if len(self) > 150_000:
                self.clear()
            got = self[word] = xxhash.xxh3_64_intdigest(word)
            return got

    return Cache()


def hashes(words, cache):
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def finish(x):
    """Spread a combined hash over all 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(MIX[3])
    return x ^ (x >> np.uint64(32))


def rolling(h, k):
    out = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        out = out * np.uint64(MIX[0]) + h[i : len(h) - k + 1 + i]
    return finish(out)


def pieces(batches, rows=1000):
    """Arrow batches in smaller slices, so that Python objects of few rows exist at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def tidy():
    """Give freed memory back: workers stay for later tasks, and what they keep counts against their executor."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(task):
    """A function of one group that leaves nothing behind in its worker once it has answered."""
    from functools import wraps

    @wraps(task)
    def run(*args):
        tidy()
        out = task(*args)
        tidy()
        return out

    return run


def as_bytes(column):
    """A string column as Python bytes, nulls as None."""
    return column.cast(pa.binary()).to_pylist()


def shingle_set(text, cache):
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes(words, cache)
    if len(h) < SHINGLE:
        return rolling(h, len(h)) ^ np.uint64(len(h))
    return np.unique(rolling(h, SHINGLE))


def pack48(tokens):
    """The upper 48 bits of sorted 64-bit tokens, six bytes each."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpack48(blob):
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view(np.uint64).ravel()


# ---------------------------------------------------------------- op1: sets, lists, verification


def set_rows(batches, schema):
    """(doc_id, tx, text) -> rid, doc_id, tx, n, dup_of, toks, mh, digest; a set seen before in this task gets dup_of and no tokens."""
    from hashlib import blake2b

    part, count, seen, cache = TaskContext.get().partitionId(), 0, {}, hash_cache()
    mixes = np.array(MIX, np.uint64)[:, None]
    for batch in pieces(batches):
        rid, size, dup, toks, mins, digests = [], [], [], [], [], []
        for text in as_bytes(batch.column(2)):
            me = (part << 40) | count
            count += 1
            s = shingle_set(text or b"", cache)
            rid.append(me)
            size.append(len(s))
            first = digest = None
            if len(s):
                digest = blake2b(s.tobytes(), digest_size=16).digest()
                first = seen.setdefault(digest, me)
                first = None if first == me else first
            dup.append(first)
            digests.append(digest)
            if not len(s) or first is not None:
                toks.append(None)
                mins.append(None)
            else:
                toks.append(pack48(s))
                mins.append((s * mixes).min(axis=1).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(dup, pa.int64()), pa.array(toks, pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(digests, pa.binary())], schema=schema)
    seen = cache = batch = toks = mins = None
    tidy()


def key40(tokens, buckets):
    """(bucket, 32-bit key) of 48-bit tokens."""
    b = tokens % np.uint64(buckets)
    return b.astype(np.int64), ((tokens // np.uint64(buckets)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def dealt(bucket, buckets):
    """An order by bucket and the bounds of each bucket in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def count_rows(batches, buckets):
    """The low tokens of each set, by bucket, for counting."""
    held, n = [], 0

    def flush():
        b, q = key40(np.concatenate(held), buckets)
        order, cut = dealt(b, buckets)
        q = q[order]
        full = [i for i in range(buckets) if cut[i + 1] > cut[i]]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([np.sort(q[cut[i] : cut[i + 1]]).tobytes() for i in full], pa.binary())], names=["bucket", "blob"])

    for batch in pieces(batches):
        for blob in batch.column(0).to_pylist():
            t = unpack48(blob)
            held.append(t[: int(len(t) * PREFIX_SHARE) + 1])
            n += len(held[-1])
        if n > 1_500_000:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()
    held = None
    tidy()


@lean
def frequent(table, least, most):
    """The keys of one bucket counted more than `least` times; the `most` most frequent of them if there are more."""
    keys, counts = np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column(1).to_pylist()]), return_counts=True)
    hot = np.flatnonzero(counts > least)
    if len(hot) > most:
        hot = np.sort(hot[np.lexsort((keys[hot], -counts[hot]))[:most]])
    full = keys[hot].astype(np.int64) | (np.int64(table.column(0)[0].as_py()) << 32)
    return pa.table({"keys": pa.array([full.tobytes()], pa.binary()), "counts": pa.array([counts[hot].astype(np.int64).tobytes()], pa.binary())})


def list_rows(batches, buckets, hot_keys, hot_counts):
    """rid, toks, chunk -> prefix entries of each set by bucket: rarest tokens first, then frequent ones by count."""
    held, n = [], 0

    def flush():
        toks = np.concatenate([x[2] for x in held])
        lens = np.array([len(x[2]) for x in held])
        own = np.repeat(np.arange(len(held)), lens)
        pos = np.minimum(np.arange(len(toks)) - np.repeat(np.cumsum(lens) - lens, lens), 65535).astype(np.uint16)
        rid, chunk, size = (np.array([x[i] for x in held], d) for i, d in ((0, np.int64), (1, np.int64), (3, np.uint32)))
        b, q = key40(toks, buckets)
        order, cut = dealt(b, buckets)
        at, blobs = [], []
        for i in range(buckets):
            o = order[cut[i] : cut[i + 1]]
            if len(o):
                sets, inner = np.unique(own[o], return_inverse=True)
                head = np.concatenate([rid[sets].view(np.uint8), chunk[sets].view(np.uint8), size[sets].view(np.uint8)]).tobytes()
                at.append(i)
                blobs.append([len(sets).to_bytes(4, "little") + pa.compress(head, "zstd", asbytes=True), q[o].tobytes(), pos[o].tobytes(), inner.astype(np.uint32).tobytes()])
        cols = [pa.array([x[k] for x in blobs], pa.binary()) for k in range(4)]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *cols], names=["bucket", "head", "q", "pos", "own"])

    for batch in pieces(batches):
        for rid, blob, chunk in zip(*(c.to_pylist() for c in batch.columns)):
            t = unpack48(blob)
            k = len(t) - (3 * len(t) + 3) // 4 + 1
            if len(hot_keys):
                b, q = key40(t, buckets)
                full = (b << 32) | q.astype(np.int64)
                at = np.minimum(np.searchsorted(hot_keys, full), len(hot_keys) - 1)
                rank = np.where(hot_keys[at] == full, hot_counts[at], 0)
                t_order = np.argsort(rank, kind="stable")[:k]
                held.append((rid, chunk, t[t_order], len(t)))
            else:
                held.append((rid, chunk, t[:k], len(t)))
            n += k
        if n > 1_000_000:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()
    held = None
    tidy()


def need(a, b):
    """Smallest intersection of sets of sizes a and b whose Jaccard similarity is 3/4: ceil(3 (a + b) / 7)."""
    return (3 * (a + b) + 6) // 7


@lean
def list_pairs(table, targets):
    """One bucket's lists -> distinct (left chunk, right set) that may hold a link; -1 stands for the chunk itself."""
    rid, chunk, size, q, pos = [], [], [], [], []
    for head, qs, ps, own in zip(*(table.column(c).to_pylist() for c in ("head", "q", "pos", "own"))):
        k = int.from_bytes(head[:4], "little")
        raw = pa.decompress(head[4:], k * 20, "zstd", asbytes=True)
        own = np.frombuffer(own, np.uint32)
        rid.append(np.frombuffer(raw, np.int64, k)[own])
        chunk.append(np.frombuffer(raw, np.int64, k, 8 * k)[own])
        size.append(np.frombuffer(raw, np.uint32, k, 16 * k)[own].astype(np.int64))
        q.append(np.frombuffer(qs, np.uint32))
        pos.append(np.frombuffer(ps, np.uint16).astype(np.int64))
    rid, chunk, size, q, pos = map(np.concatenate, (rid, chunk, size, q, pos))
    order = np.argsort(q, kind="stable")
    qs = q[order]
    start = np.flatnonzero(np.r_[True, qs[1:] != qs[:-1]])
    length = np.diff(np.r_[start, len(qs)])
    lefts, rights, new = [], [], 0

    def keep(left, right):
        """Collect pairs; they are made distinct whenever as many came as PAIRS, so repeats never pile up."""
        nonlocal lefts, rights, new
        lefts.append(left)
        rights.append(right)
        new += len(left)
        if new > PAIRS:
            left, right = unique_pairs(np.concatenate(lefts), np.concatenate(rights))
            lefts, rights, new = [left], [right], 0

    def add(ca, ra, cb, rb):
        """Pairs of sets: the smaller chunk id is the left one."""
        swap = ca > cb
        keep(np.where(swap, cb, ca), np.where(ca == cb, -1, np.where(swap, ra, rb)))

    # short lists: all pairs at distance 1, 2, ... in order of size, until sizes are too far apart
    short = np.repeat((length > 1) & (length <= LONG_LIST), length)
    o = order[short]
    o = o[np.lexsort((size[o], q[o]))]
    rid_s, chunk_s, size_s, q_s, pos_s = rid[o], chunk[o], size[o], q[o], pos[o]
    act, d = np.arange(len(o)), 0
    while len(act):
        d += 1
        act = act[act + d < len(o)]
        j = act + d
        near = (q_s[act] == q_s[j]) & (4 * size_s[act] >= 3 * size_s[j])
        act, j = act[near], j[near]
        good = (1 + np.minimum(size_s[act] - pos_s[act], size_s[j] - pos_s[j]) - 1 >= need(size_s[act], size_s[j])) & (rid_s[act] != rid_s[j])
        add(chunk_s[act[good]], rid_s[act[good]], chunk_s[j[good]], rid_s[j[good]])
    # long lists: blocks of similar sets, skipped as wholes by size and by what can still follow their positions
    for s, m in zip(start[length > LONG_LIST], length[length > LONG_LIST]):
        o = order[s : s + m]
        r, c, n, left = rid[o], chunk[o], size[o], size[o] - pos[o]
        names, block = np.unique(c, return_inverse=True)
        lo, hi, rest = np.full(len(names), 1 << 40), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        np.minimum.at(lo, block, n)
        np.maximum.at(hi, block, n)
        np.maximum.at(rest, block, left)
        for i in range(len(names)):
            ok = (block >= i) & (4 * n >= 3 * lo[i]) & (3 * n <= 4 * hi[i]) & (np.minimum(rest[i], left) >= need(lo[i], n))
            if block[ok].size and not (np.count_nonzero(block == i) == 1 and np.array_equal(np.flatnonzero(ok), np.flatnonzero(block == i))):
                cb = c[ok]
                keep(np.full(len(cb), names[i]), np.where(cb == names[i], -1, r[ok]))
    if not lefts:
        return pa.table({"target": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    return pack_pairs(np.concatenate(lefts), np.concatenate(rights), targets)


def unique_pairs(left, right):
    both = np.unique(np.stack([left, right], axis=1), axis=0) if len(left) < 1000 else None
    if both is not None:
        return both[:, 0], both[:, 1]
    o = np.lexsort((right, left))
    left, right = left[o], right[o]
    keep = np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]
    return left[keep], right[keep]


def pack_pairs(left, right, targets):
    left, right = unique_pairs(left, right)
    t = (finish(left.astype(np.int64).view(np.uint64)) % np.uint64(targets)).astype(np.int64)
    order, cut = dealt(t, targets)
    full = [i for i in range(targets) if cut[i + 1] > cut[i]]
    blobs = [np.stack([left[o], right[o]]).tobytes() for o in (order[cut[i] : cut[i + 1]] for i in full)]
    return pa.table({"target": pa.array(full, pa.int64()), "blob": pa.array(blobs, pa.binary())})


@lean
def merge_pairs(table):
    got = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("blob").to_pylist()]
    left, right = unique_pairs(*np.concatenate(got, axis=1))
    return pa.table({"chunk": pa.array(left, pa.int64()), "rid": pa.array(right, pa.int64())})


def typical(sets):
    """The set that differs least from all of them: the fewest sum of differing tokens."""
    if len(sets) == 1:
        return 0
    cat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inner, held = np.unique(cat, return_inverse=True, return_counts=True)
    return int(np.bincount(own, len(sets) - 2.0 * held[inner], len(sets)).argmin())


class Derived:
    """Answers of similar left sets: the intersections of any set with each of them, derived from that with the typical one.

    |r & l| = |r & t| + |r & (l - t)| - |r & (t - l)|.  Where l and t differ in more tokens than l has, the answer is computed
    from l's tokens alone.
    """

    def __init__(self, left):
        self.n, self.base = len(left), left[typical(left)]
        self.sizes = np.array([len(s) for s in left])
        self.derived = np.ones(self.n, bool)
        toks, who, sign = [], [], []
        for i, s in enumerate(left):
            if s is self.base:
                continue
            at = np.searchsorted(self.base, s)
            at[at == len(self.base)] = 0
            same = self.base[at] == s
            lost = np.ones(len(self.base), bool)
            lost[at[same]] = False
            self.derived[i] = len(s) - 2 * same.sum() + len(self.base) <= len(s)
            parts = ((s[~same], 1), (self.base[lost], -1)) if self.derived[i] else ((s, 1),)
            for part, sgn in parts:
                toks.append(part)
                who.append(np.full(len(part), i))
                sign.append(np.full(len(part), sgn))
        toks, self.who, self.sign = (np.concatenate(x) if x else np.zeros(0, d) for x, d in ((toks, np.uint64), (who, np.int64), (sign, np.int64)))
        o = np.argsort(toks, kind="stable")
        toks, self.who, self.sign = toks[o], self.who[o], self.sign[o]
        self.start = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]]) if len(toks) else np.zeros(0, np.int64)
        self.names, self.held = toks[self.start], np.diff(np.r_[self.start, len(toks)])

    def answers(self, sets):
        """Matrix of the intersections of sets (rows) with the left ones (columns)."""
        toks, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.base, toks), len(self.base) - 1)
        base = np.bincount(of[self.base[at] == toks], minlength=len(sets))
        both = base[:, None] * self.derived[None, :]
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, toks), len(self.names) - 1)
            hit = self.names[at] == toks
            at, of = at[hit], of[hit]
            reps = self.held[at]
            if len(at):
                flat = np.repeat(self.start[at] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())
                cell = np.repeat(of, reps) * self.n + self.who[flat]
                both = both + np.bincount(cell, self.sign[flat], len(sets) * self.n).reshape(len(sets), self.n).astype(np.int64)
        return both


def group_links(ids, sets, copies, n_left, self_too):
    """Links of left sets with right ones (and among the left), exactly.

    Gives (a, b, null), pairs that connect all sets that links connect, and (a, null, n): n rows link with a here, as every
    linked set counts with its copies.
    """
    copies, degree = np.array(copies, np.int64), np.zeros(len(sets), np.int64)
    sizes = np.array([len(s) for s in sets])
    lens = sizes[:n_left]
    left = Derived(sets[:n_left])
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, todo = [], np.arange(0 if self_too else n_left, len(sets))
    # as many sets at a time as keep the expanded matches in bounds
    part = np.cumsum(sizes[todo]) * n_left // 2_000_000
    for some in np.split(todo, np.flatnonzero(np.diff(part)) + 1) if len(todo) else ():
        both = left.answers([sets[i] for i in some])
        union = sizes[some][:, None] + lens[None, :] - both
        rows, cols = np.nonzero((100 * both >= 75 * union) & (both > 0))
        whole, far = some[rows], some[rows] >= n_left
        each = whole != cols
        np.add.at(degree, whole[each], copies[cols[each]])
        np.add.at(degree, cols[far], copies[whole[far]])
        for r, c in zip(rows.tolist(), cols.tolist()):
            a, b = find(int(some[r])), find(c)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((ids[some[r]], ids[c], None))
    return out + [(ids[i], None, int(degree[i])) for i in np.flatnonzero(degree)]


#: Right sets and tokens held at a time beside a chunk's own.
RIGHT_SETS, RIGHT_TOKENS = 2048, 1 << 21


def verify_rows(batches):
    """Rows (chunk, salt, role, rid, toks, copies) sorted by chunk, salt, role: 0 compares the left ones too, 1 left, 2 right -> a, b, n."""
    state = {"key": None, "ids": [], "sets": [], "copies": [], "left": 0, "self": False, "right": 0}
    out = []

    def answer():
        if state["left"] and (state["self"] and state["left"] > 1 or len(state["ids"]) > state["left"]):
            out.extend(group_links(state["ids"], state["sets"], state["copies"], state["left"], state["self"]))

    def made():
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["a", "b", "n"])

    for batch in pieces(batches, 200):
        for chunk, salt, role, rid, blob, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if (chunk, salt) != state["key"]:
                answer()
                state.update(key=(chunk, salt), ids=[], sets=[], copies=[], left=0, self=False, right=0)
            if role == 0:
                state["self"] = True
                continue
            state["ids"].append(rid)
            state["sets"].append(unpack48(blob))
            state["copies"].append(copies)
            state["left"] += role == 1
            state["right"] += (role == 2) * len(state["sets"][-1])
            if role == 2 and (len(state["ids"]) - state["left"] >= RIGHT_SETS or state["right"] >= RIGHT_TOKENS):
                answer()  # the right sets so far; the left ones stay
                state.update({k: state[k][: state["left"]] for k in ("ids", "sets", "copies")}, self=False, right=0)
        if out:
            yield made()
            out.clear()
    answer()
    if out:
        yield made()
    tidy()


# ---------------------------------------------------------------- op9: quality measures


SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def repeated_words(h, k=8):
    """Words inside k-word windows that stand twice or more in the text."""
    if len(h) < k + 1:
        return 0
    w = rolling(h, k)
    o = np.argsort(w, kind="stable")
    s = w[o]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w) + 1, bool)
    twice[o[1:][same]] = True
    twice[o[:-1][same]] = True
    step = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(twice[:-1])
    np.add.at(step, at, 1)
    np.add.at(step, at + k, -1)
    return int((np.cumsum(step[:-1]) > 0).sum())


def quality_rows(batches, schema):
    """(key..., text) -> key columns and the measures."""
    cache = hash_cache()
    for batch in pieces(batches):
        rows = []
        for raw in as_bytes(batch.column(batch.num_columns - 1)):
            raw = raw or b""
            words = raw.split()
            text = raw.decode("utf-8", "replace")
            seen, dup = set(), 0
            for line in raw.split(b"\n"):
                if line and not line.isspace():
                    dup += line in seen
                    seen.add(line)
            rows.append((len(words), len(text) - sum(map(text.count, SPACES)), len(raw) - len(raw.translate(None, b"#*$%&|<>")), dup, repeated_words(hashes(words, cache)), len(seen) + dup))
        cols = list(zip(*rows)) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], schema=schema)
    cache = batch = rows = None
    tidy()


# ---------------------------------------------------------------- op2: secrets

#: The base patterns.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Weak parts of a credential: reported only beside a complementary part.
WEAK_ID = r"""\b(?:access_?key_?id|client_?id|app_?id|account|user(?:name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+_.-]{3,}"""
WEAK_KEY = r"""\b(?:pwd|pass(?:phrase)?|auth|credentials?|client_?secret|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}"""
OPAQUE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}(?![A-Za-z0-9+/_-])"
ENDPOINT = r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}(?::\d+)?)"""
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")


def opaque(token):
    """Looks like random key material: three classes of characters and a high entropy."""
    import math
    from collections import Counter

    if not (any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)):
        return False
    n = len(token)
    return -sum(v / n * math.log2(v / n) for v in Counter(token).values()) >= 3.5


def secret_scanner(scope=200):
    """text -> [(start, kind number, end)] sorted."""
    import re
    from bisect import bisect_left, bisect_right
    from itertools import accumulate

    flags = re.ASCII | re.IGNORECASE
    assign, access, hexa = re.compile(ASSIGN, flags), re.compile(ACCESS), re.compile(HEX)
    weak_id, weak_key, endpoint, blob = re.compile(WEAK_ID, flags), re.compile(WEAK_KEY, flags), re.compile(ENDPOINT, flags), re.compile(OPAQUE, re.ASCII)
    blank = re.compile(r"\n[ \t]*\n")

    def scan(text):
        found = [(m.start(), 2, m.end()) for m in hexa.finditer(text)]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text)]
        weak = []
        for m in assign.finditer(text):
            long = m.end(2) - m.start(2) >= 8
            (found if long else weak).append((m.start(), 0 if long else 4, m.end()))
        weak += [(m.start(), 4, m.end()) for m in weak_key.finditer(text)]
        weak += [(m.start(), 4, m.end()) for m in blob.finditer(text) if opaque(m[0])]
        if found or weak:
            ids = [(m.start(), 3, m.end()) for m in weak_id.finditer(text)]
            ends = [(m.start(), 5, m.end()) for m in endpoint.finditer(text)]
            found.sort()
            reach = list(accumulate((b[2] for b in found), max))  # the furthest end among strong spans so far
            inside = lambda w: (i := bisect_right(found, (w[0], 9, 0))) > 0 and reach[i - 1] >= w[2]
            weak = [w for w in {*weak, *ids, *ends} if not inside(w)]
            cuts = [m.start() for m in blank.finditer(text)]
            # parts by role, sorted by start: 0 identifiers, 1 secrets, 2 endpoints
            roles = {0: 1, 1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
            parts = {r: sorted(x for x in [*found, *weak] if roles[x[1]] == r) for r in (0, 1, 2)}
            partners = {0: (1,), 1: (0, 2), 2: (1,)}
            ends_of = {r: sorted(x[2] for x in side) for r, side in parts.items()}

            def beside(w):
                """Whether a complementary part lies within the scope: an interval join by binary search.  No part holds a blank
                line, so on either side the nearest part decides."""
                for r in partners[roles[w[1]]]:
                    side = parts[r]
                    i = bisect_left(side, (w[2], -1, -1))
                    if i < len(side) and side[i][0] <= w[2] + scope and bisect_right(cuts, w[0]) == bisect_right(cuts, side[i][0]):
                        return True
                    i = bisect_right(ends_of[r], w[0]) - 1
                    if i >= 0 and ends_of[r][i] >= w[0] - scope and bisect_right(cuts, ends_of[r][i] - 1) == bisect_right(cuts, w[0]):
                        return True
                return False

            found += [w for w in weak if beside(w)]
        return sorted(found)

    return scan


def secret_rows(batches, schema):
    scan = secret_scanner()
    for batch in pieces(batches):
        spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t or "")] for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, schema.field("spans").type)], schema=schema)
    tidy()


def redact_rows(batches, mask):
    """Texts with spans masked, in the column text; other columns as they are."""
    scan = secret_scanner()
    for batch in pieces(batches):
        at = batch.schema.get_field_index("text")
        out = []
        for t in batch.column(at).to_pylist():
            for s, k, e in reversed(_merged(scan(t))) if t else ():
                t = t[:s] + mask + t[e:]
            out.append(t)
        yield batch.set_column(at, batch.schema.field(at), pa.array(out, pa.string()))


def _merged(spans):
    out = []
    for s, k, e in spans:
        if out and s <= out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


# ---------------------------------------------------------------- op10: backoff automaton

START, END = 0x5BD1E995C0FFEE11, 0x1B873593DEADBEE5
#: Tokens of a block and of a piece of a text; together under 2 ** WORD_BITS, so three words of a block fit into 63 bits.
BLOCK_TOKENS, PIECE_TOKENS, WORD_BITS = 1_200_000, 250_000, 21


def planes(x, width):
    """Unsigned integers as byte planes, compressed."""
    raw = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def unplanes(blob, width):
    n = int.from_bytes(blob[:8], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(pa.decompress(blob[8:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(np.uint64).ravel()


def spread(hashed, buckets):
    return (hashed % np.uint64(buckets)).astype(np.int64)


def by_bucket(hashed, buckets):
    """Order of hashes by bucket and hash, and (bucket, from, to) of the buckets that hold any."""
    b = spread(hashed, buckets)
    order = np.lexsort((hashed, b))
    return order, runs(b[order])


def runs(b):
    """(value, from, to) of the runs of equal values."""
    cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, np.int64)
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cut[:-1], cut[1:])]


def binary_rows(rows, names):
    """Rows whose first two values are integers, the others bytes."""
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.binary()) for i, c in enumerate(cols)], names=names)


LM_ROW = ["block", "bucket", "a", "b", "c", "d", "e", "f"]


def block_rows(batches, held_out_of):
    """(doc_id, text) -> one row for each block of pieces of texts.

    A piece is two words before it (starts for a text's first), its tokens and an end; words are numbered as they appear, 0 the
    start and 1 the end.  a: ids of the pieces' rows, b: their tokens * 4 + learned from * 2 + last of its text, c: all
    pieces, d: hashes of the words, e: number of each piece's row, f: count of each word in what is learned from.
    """
    import zlib

    import xxhash

    class Vocab(dict):
        def __missing__(self, word):
            got = self[word] = len(self) + 2
            return got

    part, serial, row = TaskContext.get().partitionId(), 0, 0
    vocab, flat, lens, rows, at, total = Vocab(), [], [], [], [], 0

    def flush():
        nonlocal vocab, flat, lens, rows, at, total, serial
        words, n = np.concatenate(flat), np.array(lens, np.int64)
        hashed = np.fromiter((START, END, *map(xxhash.xxh3_64_intdigest, vocab)), np.uint64, len(vocab) + 2)
        where, _ = scored(n >> 2)
        learned = words[where][np.repeat((n >> 1) & 1, n >> 2) > 0]
        ids = pa.concat_arrays(at)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema([("doc_id", ids.type)])) as w:
            w.write_batch(pa.record_batch([ids], names=["doc_id"]))
        out = ((part << 32) | serial, -1, sink.getvalue().to_pybytes(), planes(n, 5), planes(words, 3), planes(hashed, 8), planes(np.array(rows, np.int64), 8), planes(np.bincount(learned, minlength=len(hashed)), 4))
        serial += 1
        vocab, flat, lens, rows, at, total = Vocab(), [], [], [], [], 0
        return binary_rows([out], LM_ROW)

    for batch in pieces(batches):
        names = batch.column(0).to_pylist()
        for i, (name, text) in enumerate(zip(names, as_bytes(batch.column(1)))):
            words = (text or b"").lower().split()
            learn = zlib.crc32(("" if name is None else str(name)).encode()) % held_out_of != 0
            before = (0, 0)
            for start in range(0, len(words) + 1, PIECE_TOKENS):
                some = words[start : start + PIECE_TOKENS]
                last = start + PIECE_TOKENS > len(words)
                got = np.fromiter(map(vocab.__getitem__, some), np.int64, len(some))
                # the end of the last piece is a token; one more stands behind every piece, to ask for its last pair
                flat.append(np.r_[before, got, [1, 1] if last else [1]])
                n = len(some) + last
                lens.append(n * 4 + learn * 2 + last)
                rows.append((part << 40) | row)
                at.append(batch.column(0).slice(i, 1))
                total += n + 3
                if not last:
                    tail = words[max(0, start + PIECE_TOKENS - 2) : start + PIECE_TOKENS]
                if total >= BLOCK_TOKENS:
                    yield flush()
                if not last:  # numbers of the block that the next piece is in
                    before = tuple([0] * (2 - len(tail)) + [vocab[w] for w in tail])
            row += 1
    if lens:
        yield flush()
    tidy()


def scored(n):
    """Positions of the tokens of pieces of n tokens among all that stands in them, and where each piece begins."""
    starts = np.cumsum(n + 3) - n - 3
    shift = np.repeat(starts + 2 - (np.cumsum(n) - n), n)
    return np.arange(len(shift)) + shift, starts


def word_asks(batches, buckets):
    """block, d, f -> for each bucket that the block has words of: their hashes and counts."""
    for batch in pieces(batches, 1):
        for block, hashed, counts in zip(*(c.to_pylist() for c in batch.columns)):
            hashed, counts = unplanes(hashed, 8), unplanes(counts, 4)
            order, parts = by_bucket(hashed, buckets)
            hashed, counts = hashed[order], counts[order]
            yield binary_rows([(block, b, planes(np.diff(hashed[i:j], prepend=np.uint64(0)), 8), planes(counts[i:j], 4)) for b, i, j in parts], LM_ROW[:4])
    tidy()


def totals_of(keys, counts):
    """Sums of counts by key, and the place of each entry's key among them."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.r_[True, s[1:] != s[:-1]]
    inner = np.empty(len(keys), np.int64)
    inner[order] = np.cumsum(first) - 1
    return np.add.reduceat(counts[order], np.flatnonzero(first)), inner


@lean
def word_totals(table, buckets):
    """One bucket of words: a number for each, frequent ones first, and its total, sent back to each block in the order in which
    it asked.  c and d, on one row: the tokens and the words of the bucket that are learned from."""
    blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
    keys = [np.cumsum(unplanes(x, 8)) for x in table.column("a").to_pylist()]
    counts = np.concatenate([unplanes(x, 4) for x in table.column("b").to_pylist()]).astype(np.int64)
    totals, inner = totals_of(np.concatenate(keys), counts)
    number = np.empty(len(totals), np.int64)
    number[np.argsort(-totals, kind="stable")] = np.arange(len(totals)) * buckets + bucket
    cut = np.cumsum([0, *map(len, keys)])
    rows = [(block, bucket, planes(number[inner[i:j]], 5), planes(totals[inner[i:j]], 6), b"", b"") for block, i, j in zip(blocks, cut[:-1], cut[1:])]
    rows[0] = (*rows[0][:4], int(totals.sum()).to_bytes(8, "big"), int((totals > 0).sum()).to_bytes(8, "big"))
    return pa.Table.from_batches([binary_rows(rows, LM_ROW[:6])])


class Trigrams:
    """The distinct trigrams of a block's pieces, in the order of their words' numbers, and their pairs (the first two words).

    words: all pieces, by place in numbers, which ascends; n: tokens of each piece.  Every token has a trigram, and so has
    the end behind each piece, whose pair is the piece's last one.
    """

    def __init__(self, words, numbers, n, buckets):
        self.at, starts = scored(n)
        self.ends = starts + n + 2
        bits, every = WORD_BITS, np.ones(len(words), bool)
        every[starts] = every[starts + 1] = False
        every = np.flatnonzero(every)
        packed = words[every - 2] << bits
        packed |= words[every - 1]
        packed <<= bits
        packed |= words[every]
        order = np.argsort(packed, kind="stable")
        packed = packed[order]
        first = np.r_[True, packed[1:] != packed[:-1]]
        self.which = np.empty(len(words), np.int32)
        self.which[every[order]] = np.cumsum(first, dtype=np.int32) - 1
        self.packed = packed[first]
        del every, order, packed, first
        pair = self.packed >> bits
        new = np.r_[True, pair[1:] != pair[:-1]]
        self.pair, pairs = np.cumsum(new) - 1, pair[new]
        self.u, self.v, self.w = self.packed >> 2 * bits, pair & ((1 << bits) - 1), self.packed & ((1 << bits) - 1)
        hashed = finish(numbers[pairs >> bits].astype(np.uint64) * np.uint64(MIX[0]) + numbers[pairs & ((1 << bits) - 1)].astype(np.uint64))
        bucket = spread(hashed, buckets)
        self.pair_order = np.argsort(bucket, kind="stable")
        self.order = np.argsort(bucket[self.pair], kind="stable")
        self.buckets = runs(bucket[self.pair][self.order])


@lean
def trigram_asks(table, buckets):
    """A block and the numbers and totals of its words -> the block with its words in the order of their numbers (d: the numbers,
    f: the totals), and for each bucket that it has trigrams of: the trigrams' numbers, each as far as it differs from the
    one before, and their counts."""
    cols = {c: table.column(c).to_pylist() for c in LM_ROW}
    rows = sorted(range(len(cols["block"])), key=lambda i: cols["bucket"][i])
    head = rows[0]
    block, n = cols["block"][head], unplanes(cols["b"][head], 5).astype(np.int64)
    hashed = unplanes(cols["d"][head], 8)
    order, parts = by_bucket(hashed, buckets["words"])
    if cols["bucket"][head] != -1 or [cols["bucket"][i] for i in rows[1:]] != [b for b, _, _ in parts]:
        raise ValueError("a block lacks itself or answers")
    numbers, totals = np.empty(len(hashed), np.int64), np.empty(len(hashed), np.int64)
    numbers[order] = np.concatenate([unplanes(cols["a"][i], 5) for i in rows[1:]]).astype(np.int64)
    totals[order] = np.concatenate([unplanes(cols["b"][i], 6) for i in rows[1:]]).astype(np.int64)
    up = np.argsort(numbers)
    place = np.empty(len(up), np.int64)
    place[up] = np.arange(len(up))
    words, numbers, totals = place[unplanes(cols["c"][head], 3).astype(np.int64)], numbers[up], totals[up]
    t = Trigrams(words, numbers, n >> 2, buckets["pairs"])
    learn = np.zeros(len(words), np.int64)
    learn[t.at] = np.repeat((n >> 1) & 1, n >> 2)
    learn[t.ends] = ((n >> 1) & 1) * (n & 1)  # behind a text's end only
    every = np.r_[t.at, t.ends]
    counts = np.bincount(t.which[every], learn[every], len(t.packed)).astype(np.int64)[t.order]
    u, v, w = numbers[t.u[t.order]], numbers[t.v[t.order]], numbers[t.w[t.order]]
    # the places of start (0) and end (1) are needed again, as are all words' totals
    out = [(block, -1, cols["a"][head], cols["b"][head], planes(words, 3), planes(np.r_[place[:2], np.diff(numbers, prepend=0)], 5), cols["e"][head], planes(totals, 6))]
    for b, i, j in t.buckets:
        du = np.diff(u[i:j], prepend=0)
        same = np.r_[False, du[1:] == 0]
        dv = np.where(same, np.diff(v[i:j], prepend=0), v[i:j])
        same &= dv == 0
        dw = np.where(same, np.diff(w[i:j], prepend=0), w[i:j])
        out.append((block, b, planes(du, 5), planes(dv, 5), planes(dw, 5), planes(counts[i:j], 4), None, None))
    return pa.Table.from_batches([binary_rows(out, LM_ROW)])


def rising(d, new):
    """Values from differences that begin anew where new holds."""
    total = np.cumsum(d)
    at = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    return total - total[at] + d[at]


@lean
def trigram_totals(table):
    """One bucket of pairs: the totals of the trigrams (a) and of the pairs (b) that each block asked for, in its order."""
    tri, pair, counts, sizes = [], [], [], []
    for a, b, c, d in zip(*(table.column(x).to_pylist() for x in "abcd")):
        u = np.cumsum(unplanes(a, 5).astype(np.int64))
        new = np.r_[True, u[1:] != u[:-1]]
        v = rising(unplanes(b, 5).astype(np.int64), new)
        new |= np.r_[True, v[1:] != v[:-1]]
        w = rising(unplanes(c, 5).astype(np.int64), new)
        key = finish(u.astype(np.uint64) * np.uint64(MIX[0]) + v.astype(np.uint64))
        tri.append(finish(key * np.uint64(MIX[1]) + w.astype(np.uint64)))
        pair.append((key, np.flatnonzero(new)))
        counts.append(unplanes(d, 4).astype(np.int64))
        sizes.append(len(u))
    cut, all_counts = np.cumsum([0, *sizes]), np.concatenate(counts)
    totals, inner = totals_of(np.concatenate(tri), all_counts)
    replies = [planes(totals[inner[i:j]], 6) for i, j in zip(cut[:-1], cut[1:])]
    del tri, totals, inner
    heads = [np.add.reduceat(c, at) for c, (_, at) in zip(counts, pair)]
    pair_cut = np.cumsum([0, *map(len, heads)])
    totals, inner = totals_of(np.concatenate([key[at] for key, at in pair]), np.concatenate(heads))
    rows = [(block, bucket, r, planes(totals[inner[i:j]], 6), None, None, None, None) for block, bucket, r, i, j in zip(table.column("block").to_pylist(), table.column("bucket").to_pylist(), replies, pair_cut[:-1], pair_cut[1:])]
    return pa.Table.from_batches([binary_rows(rows, LM_ROW)])


@lean
def score_block(table, schema, buckets, total, kinds, mu):
    """One block: build the part of the automaton that its pieces walk through, and run every piece through it.

    States are the contexts: the empty one, each word and each pair of words learned from.  A state's arc over a word that was
    seen behind it weighs that word's smoothed log-probability and leads to the state of the last two words; its failure arc
    weighs log10(mu / (count + mu)) and leads to the state without its first word.  Whatever the path, the state after a
    word is that of the last two words, so a walk's steps need not wait for each other: they are taken for all tokens at
    once, each from its own state down the failure arcs to the first state with an arc over the word.
    """
    cols = {c: table.column(c).to_pylist() for c in LM_ROW}
    rows = sorted(range(len(cols["block"])), key=lambda i: cols["bucket"][i])
    head = rows[0]
    n, words, ahead = unplanes(cols["b"][head], 5).astype(np.int64), unplanes(cols["c"][head], 3).astype(np.int64), unplanes(cols["d"][head], 5).astype(np.int64)
    (start, end), numbers, totals = ahead[:2], np.cumsum(ahead[2:]), unplanes(cols["f"][head], 6).astype(np.int64)
    t = Trigrams(words, numbers, n >> 2, buckets)
    if cols["bucket"][head] != -1 or [cols["bucket"][i] for i in rows[1:]] != [b for b, _, _ in t.buckets]:
        raise ValueError("a block lacks itself or answers")
    seen, pairs = np.empty(len(t.packed), np.int64), np.empty(len(t.pair_order), np.int64)
    seen[t.order] = np.concatenate([unplanes(cols["a"][i], 6) for i in rows[1:]]).astype(np.int64)
    pairs[t.pair_order] = np.concatenate([unplanes(cols["b"][i], 6) for i in rows[1:]]).astype(np.int64)
    known = totals > 0
    behind = np.where(np.arange(len(totals)) == start, totals[end], totals)  # as many starts as ends are learned from
    # arcs of the empty state
    low = (totals + 0.1) / (total + 0.1 * (kinds + 1))
    low_log = np.log10(low)
    # arcs of words: the pair of a trigram's last two words is that of the place after it
    last = np.zeros(len(t.packed), np.int64)
    last[t.which[t.at]] = pairs[t.pair[t.which[t.at + 1]]]
    mid = (last + mu * low[t.w]) / (behind[t.v] + mu)
    weight = np.where(last > 0, np.log10(mid), np.log10(mu / (behind[t.v] + mu)) + low_log[t.w])
    # arcs of pairs
    held = pairs[t.pair]
    weight = np.where(seen > 0, np.log10((seen + mu * mid) / (held + mu)), np.log10(mu / (held + mu)) + weight)
    tokens, of = words[t.at], n >> 2
    first = np.cumsum(of) - of
    sums = lambda x: np.add.reduceat(x, first)
    ids = pa.ipc.open_stream(cols["a"][head]).read_all().column(0).combine_chunks()
    out = [pa.array(unplanes(cols["e"][head], 8).astype(np.int64)), ids, pa.array((n >> 1) & 1 == 0), pa.array(of), pa.array(sums(known[tokens].astype(np.int64))), pa.array(sums(low_log[tokens])), pa.array(sums(weight[t.which[t.at]]))]
    return pa.Table.from_arrays(out, schema=schema)


# ---------------------------------------------------------------- op5: boosted trees on lexical features


def url_features(urls, hosts, paths, *rates):
    import math
    from collections import Counter

    rows = []
    for u, h, p in zip(urls, hosts, paths):
        n = max(1, len(u))
        counts = Counter(u)
        query = u.partition("?")[2].partition("#")[0]
        rows.append((
            len(u), len(h), len(p), p.count("/"), h.count("."), sum(map(str.isdigit, u)) / n, sum(map(str.isdigit, h)), u.count("-"),
            -sum(v / n * math.log2(v / n) for v in counts.values()), query.count("=") if query else 0, query.count("&") + bool(query), "#" in u,
            u.startswith("https"), max(map(len, h.split("."))) if h else 0, len(p.rpartition("/")[2]),
        ))
    x = np.array(rows, float).reshape(len(rows), 15)
    return np.column_stack([x, *(np.asarray(r, float) for r in rates)])


def fit_trees(x, y, trees, depth, rate, bins, weights=None):
    """Boosted trees for the log-loss, of rows by weight, on binned features: (start, edges, [levels of (feature, bin)], [leaf values]) ."""
    if not len(y) or y.min() == y.max():
        return (float("-inf") if not len(y) or y[0] == 0 else float("inf"), [], [], [])
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    b = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], axis=1)
    each = np.ones(len(y)) if weights is None else weights * (len(y) / weights.sum())
    mean = np.average(y, weights=each)
    start = float(np.log(mean / (1 - mean)))
    f, out, values = np.full(len(y), start), [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, w = each * (y - p), each * np.maximum(p * (1 - p), 1e-6)
        node, splits = np.zeros(len(y), np.int64), []
        for d in range(depth):
            nodes = 1 << d
            best = np.full(nodes, -1.0)
            at = np.zeros((nodes, 2), np.int64)
            for j in range(x.shape[1]):
                key = node * bins + b[:, j]
                gs = np.bincount(key, g, nodes * bins).reshape(nodes, bins).cumsum(1)
                ws = np.bincount(key, w, nodes * bins).reshape(nodes, bins).cumsum(1)
                gt, wt = gs[:, -1:], ws[:, -1:]
                gain = gs**2 / (ws + 1) + (gt - gs) ** 2 / (wt - ws + 1) - gt**2 / (wt + 1)
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                better = top > best + 1e-12
                best[better] = top[better]
                at[better] = np.column_stack([np.full(nodes, j), k])[better]
            splits.append(at)
            node = node * 2 + (b[np.arange(len(y)), at[node, 0]] > at[node, 1])
        leaf = np.bincount(node, g, 1 << depth) / (np.bincount(node, w, 1 << depth) + 1)
        f = f + rate * leaf[node]
        out.append(splits)
        values.append(rate * leaf)
    return (start, edges, out, values)


def predict(model, x):
    start, edges, trees, values = model
    if not trees:
        return np.full(len(x), 0.0 if start < 0 else 1.0)
    b = np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], axis=1) if len(x) else np.zeros((0, len(edges)), np.int64)
    f, rows = np.full(len(x), start), np.arange(len(x))
    for splits, leaf in zip(trees, values):
        node = np.zeros(len(x), np.int64)
        for at in splits:
            node = node * 2 + (b[rows, at[node, 0]] > at[node, 1])
        f = f + leaf[node]
    return 1 / (1 + np.exp(-f))


def url_rows(batches, model, schema):
    for batch in batches:
        ids, url, host, path, rule, label, *rates = batch.columns
        p = predict(model, url_features(url.to_pylist(), host.to_pylist(), path.to_pylist(), *(r.to_numpy(zero_copy_only=False) for r in rates)))
        verdict = [x or ("block" if q >= 0.5 else "allow") for x, q in zip(label.to_pylist(), p)]
        yield pa.RecordBatch.from_arrays([ids, host, path, rule, pa.array(verdict, pa.string()), pa.array(p, pa.float64())], schema=schema)
