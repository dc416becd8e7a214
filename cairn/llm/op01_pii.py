"""Private data by a skip-chain conditional random field.

Tokens are runs of bytes that aren't white space; all tokens of a document are nodes of one chain and
get one of LABELS. Potentials:

- emission: weights of hashed features of the token, whole (shape with and without the lengths of its
  runs, digits, length, address, checksum, runs of hexadecimal and of mixed characters, how it
  begins), of the words around it and their shapes, and of whether a sentence begins there;
- chain: a weight for each pair of labels of adjacent tokens;
- skip: a bonus where two tokens of a document agree that are equal or similar (the same letters and
  digits, or the same four digits and more), however far apart; each is tied to the next one of its
  kind. Tokens with a digit or "@", those that begin with a capital and those of eight mixed
  characters and more are tied; others (common words) are not.

Loopy sum-product passes messages over both kinds of edges at once until a document's messages
settle or ROUNDS have passed; a document's result doesn't depend on others of its slice. Messages are
kept for active tokens only. A token is held at O, and gives its neighbours its potentials, as long
as its probability of another label, given what its neighbours have come to, is under EPS; tokens
above it become active, and messages are passed again, until there is none. EPS = 0 is the full chain.
A token takes its most probable label; adjacent tokens of one label are one entity (names, phone and
card numbers), trimmed to the characters that belong to it.

No table labels private tokens, so the weights are learned by pseudo-likelihood from documents that
strict patterns have labelled: of the first SAMPLE documents by a hash of doc_id, those with and
without labelled tokens by turns, whole, until FIT tokens are reached. SAMPLE and FIT are parameters
and the only bounds; they stand in for a bounded sample of labelled rows. Patterns aren't used on any
other document. Names are learned where titles ("Dr. ...") or fields ("Name: ...") introduce them; a
sample without any teaches none, and then none is tagged. Addresses are out of scope.

Defined cases. Null and empty texts have no entities; a repeated row is reported once a row; an
empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel as K
from .op08_minhash import fold
from .runtime import table

LABELS = ("O", "EMAIL", "PHONE", "IP", "CARD", "SECRET", "NAME")
SAMPLE, FIT, BITS, ROUNDS, STEPS, DAMP, DROP, EPS = 6000, 150_000, 18, 25, 60, 0.3, 0.3, 1e-4

_strict = [
    ("EMAIL", re.compile(r"[A-Za-z0-9À-￿][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    ("PHONE", re.compile(r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\+\d{1,3}(?:[ .-]\d{2,4}){3,4}|\(\d{3}\) ?\d{3}-\d{4}|(?<![\d.-])\d{3}-\d{3}-\d{4}(?![\d-])")),
    ("IP", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)")),
    ("CARD", re.compile(r"(?<!\d)\d{4}(?:[ -]?\d{4}){3}(?!\d)|(?<!\d)\d{13,19}(?!\d)")),
    ("SECRET", re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?![0-9A-Za-z])|(?:AKIA|ghp_|sk_|xox[bp]-)[0-9A-Za-z_-]{12,}")),
    ("NAME", re.compile(r"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|Sra?)\.?|(?:[Ff]ull )?[Nn]ame(?: is|:)) ((?:[A-ZÀ-Þ][\w'’-]+)(?: [A-ZÀ-Þ][\w'’-]+)?)")),
]
#: Bytes that don't count as a token's where it begins or ends.
LEAD, TRAIL = np.zeros(256, bool), np.zeros(256, bool)
LEAD[list(b"\"'<[{")], TRAIL[list(b"\"'>]},;:!?%*#$&.")] = True, True
_inside = {
    "EMAIL": re.compile(r"[^\s\"'<>()\[\]{},;:|=]+@[\w.-]*\w"),
    "PHONE": re.compile(r"[+(]?\d(?:[\d().+ -]*\d)?\)?"),
    "IP": re.compile(r"\d[\d.]*\d"),
    "CARD": re.compile(r"\d[\d -]*\d"),
    "SECRET": re.compile(r"[0-9A-Za-z_+/-]{8,}"),
    "NAME": re.compile(r"\w[\w'’-]*"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _ascii_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def strict_spans(text: str) -> list[tuple[int, int, str]]:
    """Character spans that the patterns label, for training."""
    out = []
    for label, pattern in _strict:
        for m in pattern.finditer(text):
            if label == "CARD" and not luhn(_ascii_digits(m[0])):
                continue
            begin, end = m.span(1) if pattern.groups else m.span()
            if all(end <= s or begin >= e for s, e, _ in out):
                out.append((begin, end, label))
    return out


#: Character classes of shapes: capital, small (and all beyond ASCII), digit; other bytes are their own.
CLASS = np.arange(256, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:], CLASS[48:58] = 1, 2, 2, 3
DIGIT, HEX, MIXED, ALNUM = (np.zeros(256, bool) for _ in range(4))
DIGIT[48:58] = True
HEX[[*range(48, 58), *range(65, 71), *range(97, 103)]] = True
MIXED[[*range(48, 58), *range(65, 91), *range(97, 123), 95, 45]] = True
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))


def _longest(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The longest run of flags in each span; spans aren't empty, and something unflagged parts them."""
    if not len(starts):
        return np.zeros(0, np.int64)
    at = np.arange(len(flags))
    run = np.append(at - np.maximum.accumulate(np.where(flags, -1, at)), 0)
    run[:-1][~flags] = 0
    return np.maximum.reduceat(run, np.stack([starts, ends], axis=1).ravel())[::2]


def _chosen(data: np.ndarray, flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of each span's flagged bytes."""
    total = _sums(flags)
    return K.span_hashes(data[flags], total[starts], total[ends]), total[ends] - total[starts]


class Tokens:
    """All tokens of a slice: features, and the edges that tie them."""

    def __init__(self, column: pa.Array, bits: int = BITS):
        data, offsets = K.buffers(column)
        words = K.Words(data, offsets)
        self.data, self.offsets, self.starts, self.ends, self.row = data, offsets, words.starts, words.ends, words.rows()
        n = len(words)
        self.first = words.first()
        self.last = np.append(self.first[1:], True)[:n]
        if not n:
            self.slots, self.skip = np.zeros((1, 0), np.int32), np.zeros((0, 2), np.int64)
            return
        at = np.arange(len(data))
        s = np.minimum(np.minimum.accumulate(np.where(LEAD[data], len(data), at)[::-1])[::-1][words.starts], words.ends)
        e = np.maximum(np.maximum.accumulate(np.where(TRAIL[data], -1, at))[words.ends - 1] + 1, s)
        digits, dots, ats, dashes = (_sums(x) for x in (DIGIT[data], data == 46, data == 64, data == 45))
        size, n_digits = e - s, digits[e] - digits[s]
        loose, full = self._shapes(s, e)
        small = fold(data)
        word = K.mix(K.span_hashes(small, words.starts, words.ends))
        # The last "@": what stands before it, and a dot after it.
        back = np.maximum.accumulate(np.where(data == 64, at, -1))[np.maximum(e - 1, 0)]
        has = (back >= s) & (size > 0)
        address = np.where(has, 1 + (back > s) + 2 * (dots[np.maximum(e - 1, s)] - dots[np.minimum(back + 1, np.maximum(e - 1, s))] > 0) + 4 * np.minimum(ats[e] - ats[s], 2), 0)
        valid = np.zeros(n, np.int64)
        for k in np.flatnonzero((dots[e] - dots[s] == 3) & (n_digits + 3 == size) & (size <= 15)).tolist():
            parts = data[s[k] : e[k]].tobytes().split(b".")
            valid[k] = 1 + all(x and int(x) < 256 for x in parts)
        for k in np.flatnonzero((n_digits >= 13) & (n_digits <= 19) & (n_digits + dashes[e] - dashes[s] == size)).tolist():
            valid[k] = 3 + luhn(data[s[k] : e[k]].tobytes().decode().replace("-", ""))
        long = np.flatnonzero(size >= 8)
        hexes, mixed, kinds = (np.zeros(n, np.int64) for _ in range(3))
        hexes[long], mixed[long] = _longest(HEX[data], s[long], e[long]), _longest(MIXED[data], s[long], e[long])
        for k, low, high in ((1, 65, 91), (2, 97, 123), (4, 48, 58)):
            total = _sums((data >= low) & (data < high))
            kinds[long] += k * (total[e[long]] > total[s[long]])
        hexa = np.where(hexes >= 8, 1 + np.minimum(hexes // 8, 6) * 2 + (hexes == size), 0)
        key = np.where(mixed >= 8, 1 + np.minimum(mixed // 4, 12) * 8 + kinds, 0)
        begin = np.where(key > 0, K.mix(K.span_hashes(data, s, np.minimum(s + 4, e))), np.uint64(0))
        ends_sentence = np.isin(data[words.ends - 1], list(b".!?:"))
        opens = self.first.copy()
        opens[1:] |= ends_sentence[:-1]
        before, before2, after = (self._shifted(word, k) for k in (1, 2, -1))
        shape1, shape2, shape_after = self._shifted(loose, 1), self._shifted(loose, 2), self._shifted(loose, -1)
        one = np.uint64(1)
        rows = [
            loose, full, n_digits.clip(0, 20).astype(np.uint64) + one, size.clip(0, 40).astype(np.uint64) + one, address.astype(np.uint64), valid.astype(np.uint64), valid.astype(np.uint64),
            hexa.astype(np.uint64), key.astype(np.uint64), begin, before + one, before2 + one, after + one, shape1 + one, K.mix(shape2 * np.uint64(K.PAIR) + shape1), shape_after + one,
            loose * np.uint64(2) + opens.astype(np.uint64) + one, np.full(n, 1, np.uint64),
        ]
        self.slots = np.stack([np.where(x == 0, 0, np.maximum(K.bucket(K.mix(x * np.uint64(32) + np.uint64(k)), bits), 1)).astype(np.int32) for k, x in enumerate(rows)])
        self.skip = self._ties(np.flatnonzero((n_digits > 0) | (ats[e] > ats[s]) | ((CLASS[data[np.minimum(s, len(data) - 1)]] == 1) & (size >= 3)) | (key > 0)), s, e, small)

    def __len__(self) -> int:
        return len(self.starts)

    def _shifted(self, x: np.ndarray, k: int) -> np.ndarray:
        """x of the token k places before, 0 where the document has none."""
        out = np.zeros_like(x)
        if k > 0:
            out[k:] = np.where(self.row[k:] == self.row[:-k], x[:-k], 0)
        else:
            out[:k] = np.where(self.row[:k] == self.row[-k:], x[-k:], 0)
        return out

    def _shapes(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of each core's runs of character classes: without lengths, and with those of digits."""
        code = CLASS[self.data]
        step = np.zeros(len(code) + 1, np.int64)
        some = e > s
        np.add.at(step, s[some], 1)
        np.add.at(step, e[some], -1)
        begins = np.ones(len(code), bool)
        begins[1:] = code[1:] != code[:-1]
        begins[s[some]] = True
        at = np.flatnonzero(begins & (np.cumsum(step[:-1]) > 0))
        lo, hi = np.searchsorted(at, s), np.searchsorted(at, e)
        until = np.append(at[1:], len(code))
        until[hi[some] - 1] = e[some]
        kind = code[at].astype(np.uint64) + np.uint64(1)
        sized = kind + np.where(code[at] == 3, np.minimum(until - at, 40), 0).astype(np.uint64) * np.uint64(256)
        return K.mix(K.span_hashes(kind, lo, hi)), K.mix(K.span_hashes(sized, lo, hi))

    def _ties(self, some: np.ndarray, s: np.ndarray, e: np.ndarray, small: np.ndarray) -> np.ndarray:
        """Skip edges: each token of `some` and the next one of its document that is equal or similar."""
        out = []
        for data, flags, least in ((small, ALNUM[self.data], 3), (self.data, DIGIT[self.data], 4)):
            h, size = _chosen(data, flags, s[some], e[some])
            use = size >= least
            h, at = h[use], some[use]
            order = np.lexsort((at, h, self.row[at]))
            h, at = h[order], at[order]
            same = (h[1:] == h[:-1]) & (self.row[at[1:]] == self.row[at[:-1]])
            out.append(np.stack([at[:-1][same], at[1:][same]], axis=1))
        edges = np.unique(np.concatenate(out), axis=0) if some.size else np.zeros((0, 2), np.int64)
        return edges[edges[:, 1] > edges[:, 0] + 1]

    def emission(self, w: np.ndarray) -> np.ndarray:
        total = np.zeros((len(self), w.shape[1]), w.dtype)
        for row in self.slots:
            total += w[row]
        return total

    def text(self, k: int) -> str:
        return self.data[self.starts[k] : self.ends[k]].tobytes().decode("utf-8", "replace")


def loopy(emit: np.ndarray, chain: np.ndarray, skip: np.ndarray, pair: np.ndarray, agree: float, rounds: int = ROUNDS, damp: float = DAMP, owner: np.ndarray | None = None) -> np.ndarray:
    """Node marginals by synchronous sum-product over all edges; an owner's (document's) messages stop when they have settled."""
    n, labels = emit.shape
    edges = np.concatenate([chain, skip])
    if not len(edges):
        x = np.exp(emit - emit.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)
    m = len(edges)
    owner = np.zeros(n, np.int64) if owner is None else owner
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    same = agree * np.eye(labels)
    weight = np.concatenate([np.broadcast_to(x, (k, labels, labels)) for x, k in ((pair, len(chain)), (same, len(skip)), (pair.T, len(chain)), (same, len(skip)))])
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, labels))
    live, by = np.arange(2 * m), owner[source]
    for _ in range(rounds):
        belief = emit.copy()
        np.add.at(belief, target, message)
        into = belief[source[live]] - message[back[live]]
        new = np.logaddexp.reduce(into[:, :, None] + weight[live], axis=1)
        new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
        new = damp * message[live] + (1 - damp) * new
        moved = np.zeros(int(owner.max()) + 1)
        np.maximum.at(moved, by[live], np.abs(new - message[live]).max(axis=1))
        message[live] = new
        live = live[moved[by[live]] >= 1e-4]
        if not len(live):
            break
    belief = emit.copy()
    np.add.at(belief, target, message)
    belief -= belief.max(axis=1, keepdims=True)
    x = np.exp(belief)
    return x / x.sum(axis=1, keepdims=True)


def _odds(x: np.ndarray) -> np.ndarray:
    """Odds of any label but O, from log potentials."""
    return np.exp(np.minimum(x[:, 1:] - x[:, :1], 60)).sum(axis=1)


def infer(tokens: Tokens, model: dict, eps: float = EPS) -> tuple[np.ndarray, np.ndarray]:
    """(active tokens, their marginals); all others are O."""
    e, pair, agree, n = tokens.emission(model["w"]), model["pair"], model["agree"], len(tokens)
    a, b = tokens.skip[:, 0], tokens.skip[:, 1]
    has_left, has_right = ~tokens.first, ~tokens.last
    quiet = e + has_left[:, None] * pair[0].astype(e.dtype) + has_right[:, None] * pair[:, 0].astype(e.dtype)
    quiet[:, 0] += agree * np.bincount(np.concatenate([a, b]), minlength=n)
    active = _odds(quiet) > eps if eps else np.ones(n, bool)
    while True:
        ids = np.flatnonzero(active)
        place = np.full(n + 1, -1)
        place[ids] = np.arange(len(ids))
        base = e[ids].astype(np.float64)
        left, right = has_left[ids], has_right[ids]
        calm_left, calm_right = left & ~active[ids - 1], right & ~active[np.minimum(ids + 1, n - 1)]
        base[calm_left] += pair[0]
        base[calm_right] += pair[:, 0]
        both, one, other = active[a] & active[b], active[a] & ~active[b], ~active[a] & active[b]
        base[:, 0] += agree * np.bincount(place[np.concatenate([a[one], b[other]])], minlength=len(ids))
        on = ids[left & ~calm_left]
        p = loopy(base, np.stack([place[on - 1], place[on]], axis=1), np.stack([place[a[both]], place[b[both]]], axis=1), pair, agree, owner=tokens.row[ids])
        if active.all():
            return ids, p
        # Tokens at rest beside active ones, given what these have come to without them.
        told = np.log(np.maximum(p, 1e-300))
        change: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        through = lambda cavity, w: np.logaddexp.reduce(cavity[:, :, None] + w, axis=1)
        change["right"] = ids[calm_right] + 1, through(told[calm_right] - pair[:, 0], pair) - pair[0]
        change["left"] = ids[calm_left] - 1, through(told[calm_left] - pair[0], pair.T) - pair[:, 0]
        same = agree * np.eye(len(pair))
        near, far = np.concatenate([place[a[one]], place[b[other]]]), np.concatenate([b[one], a[other]])
        change["skip"] = far, through(told[near] - same[0], same) - same[0]
        wake = np.zeros(n, bool)
        touched = np.unique(np.concatenate([at for at, _ in change.values()]))
        if len(touched):
            now = quiet[touched].astype(np.float64)
            for at, by in change.values():
                np.add.at(now, np.searchsorted(touched, at), by - by[:, :1] if len(at) else by)
            wake[touched] = _odds(now) > eps
        if not wake.any():
            return ids, p
        active |= wake


def train(texts: list[str], steps: int = STEPS, fit: int = FIT) -> dict:
    """Weights by pseudo-likelihood: each token given its neighbours' labels."""
    labels = len(LABELS)
    texts = [t or "" for t in texts]
    spans = [strict_spans(t) for t in texts]
    turns = [[i for i, x in enumerate(spans) if bool(x) == known] for known in (True, False)]
    order = [i for pair_ in zip(*turns) for i in pair_]
    order += sorted(set(range(len(texts))) - set(order))
    use, n_tokens = [], 0
    for i in order:
        if n_tokens >= fit:
            break
        use.append(i)
        n_tokens += len(texts[i].split())
    tokens = Tokens(pa.array([texts[i] for i in use], pa.string()))
    n = len(tokens)
    pair, agree = np.zeros((labels, labels)), 0.0
    if not n or not any(spans[i] for i in use):
        w = np.zeros((1 << BITS, labels), np.float32)
        w[1:, 0] = 1.0
        return {"w": w, "pair": pair, "agree": agree}
    chars = _sums((tokens.data & 0xC0) != 0x80)
    base = chars[tokens.offsets[tokens.row]]
    start, end = chars[tokens.starts] - base, chars[tokens.ends] - base
    bounds = np.searchsorted(tokens.row, np.arange(len(use) + 1))
    y = np.zeros(n, np.int64)
    for r, i in enumerate(use):
        lo, hi = bounds[r], bounds[r + 1]
        for s, e, label in reversed(spans[i]):
            y[lo + np.searchsorted(end[lo:hi], s, "right") : lo + np.searchsorted(start[lo:hi], e, "left")] = LABELS.index(label)
    known, flat = np.unique(tokens.slots, return_inverse=True)
    slots = flat.reshape(tokens.slots.shape)
    w = np.zeros((len(known), labels))
    hot, inner = np.eye(labels)[y], np.flatnonzero(~tokens.first)
    a, b = tokens.skip[:, 0], tokens.skip[:, 1]
    tied = np.zeros((n, labels))
    np.add.at(tied, a, hot[b])
    np.add.at(tied, b, hot[a])
    random = np.random.default_rng(1)
    moments = [[np.zeros_like(w), np.zeros_like(w)], [np.zeros_like(pair), np.zeros_like(pair)], [0.0, 0.0]]
    for step in range(1, steps + 1):
        # Features are left out at random, so that no token depends on a single one of them.
        kept = random.random((len(slots), n), dtype=np.float32) >= DROP
        logits = agree * tied
        for row, keep in zip(slots, kept):
            logits += np.where(keep[:, None], w[row], 0)
        logits[inner] += pair[y[inner - 1]]
        logits[inner - 1] += pair[:, y[inner]].T
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        miss = hot - p / p.sum(axis=1, keepdims=True)
        g_w = -0.02 * w
        # Tokens that are as good as settled move no weight.
        open_ = np.flatnonzero(np.abs(miss).max(axis=1) > 1e-4)
        some = slots[:, open_]
        for k in range(labels):
            weight = np.ascontiguousarray(miss[open_, k])
            for row, keep in zip(some, kept[:, open_]):
                g_w[:, k] += np.bincount(row, weight * keep, minlength=len(w))
        g_w[known == 0] = 0.0
        g_pair = hot[inner - 1].T @ miss[inner] + miss[inner - 1].T @ hot[inner] - 0.02 * pair
        g_agree = float((miss * tied).sum() - 0.5 * agree)
        moved = []
        for k, g in enumerate((g_w, g_pair, g_agree)):
            moments[k][0] = 0.9 * moments[k][0] + 0.1 * g
            moments[k][1] = 0.99 * moments[k][1] + 0.01 * g * g
            moved.append(0.15 * (moments[k][0] / (1 - 0.9**step)) / (np.sqrt(moments[k][1] / (1 - 0.99**step)) + 1e-6))
        w, pair, agree = w + moved[0], pair + moved[1], float(np.clip(agree + moved[2], 0.0, 4.0))
    full = np.zeros((1 << BITS, labels), np.float32)
    full[known] = w
    return {"w": full, "pair": pair, "agree": agree}


def entities(column: pa.Array, model: dict, eps: float = EPS) -> list[list[dict]]:
    """label, start and end (characters) of each row's entities."""
    tokens = Tokens(column)
    out: list[list[dict]] = [[] for _ in range(len(column))]
    if not len(tokens):
        return out
    ids, p = infer(tokens, model, eps)
    best = p.argmax(axis=1)
    found = ids[best > 0]
    chars = _sums((tokens.data & 0xC0) != 0x80) if len(found) else None
    before: tuple[int, str] | None = None
    for k, y in zip(found.tolist(), best[best > 0].tolist()):
        label, row, token = LABELS[y], int(tokens.row[k]), tokens.text(k)
        inner = max(_inside[label].finditer(token), key=lambda m: len(m[0]), default=None)
        s, e = inner.span() if inner else (0, len(token))
        begin = int(chars[tokens.starts[k]] - chars[tokens.offsets[row]])
        whole = label == "CARD" and (len(_ascii_digits(token)) > 6 or (before is not None and len(_ascii_digits(tokens.text(k - 1))) > 6))
        if before == (k - 1, label) and not tokens.first[k] and label in ("PHONE", "CARD", "NAME") and not whole:
            out[row][-1]["end"] = begin + e
        else:
            out[row].append({"label": label, "start": begin + s, "end": begin + e})
        before = (k, label)
    return out


def fit(docs: DataFrame, size: int = SAMPLE, tokens: int = FIT) -> dict:
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(size)
    text = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy(F.xxhash64("id"), "id")
    return train(rows.toArrow().column("text").to_pylist(), fit=tokens)


def private_documents(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_entities and entities (label, start, end in characters) of every document that has some."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, **how))
    kind = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.pieces(batches, 1):
            found = entities(batch.column(1), model.value)
            some = [i for i, x in enumerate(found) if x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some, pa.int64())), pa.array([len(found[i]) for i in some], pa.int32()), pa.array([found[i] for i in some], kind)],
                ["doc_id", "n_entities", "entities"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_entities int, entities array<struct<label: string, start: int, end: int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_documents(table(spark, sf_dir, "documents"))
