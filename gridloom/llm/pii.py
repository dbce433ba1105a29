"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions for what the rules don't fit.

The network is trained in numpy on spans that the rules label in a bounded sample, as they stand and in ways of writing that no
rule fits (`rewritten`). A text is cut into overlapping windows; each is decoded by Viterbi over the tags none, and first and further
character of each kind. Spans of all windows of a text are then reconciled over the whole text: what a window's edge cut is joined with what
its neighbour found, and of spans that overlap those with the greatest sum of margins stay. Found spans are added where they don't overlap one
of a rule.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.packed import bounded_batches, give_back

KINDS = ("email", "ip", "card", "phone")
#: Tags: 0 none, 1 + 2k the first and 2 + 2k a further character of kind k.
TAGS = 1 + 2 * len(KINDS)
HIDDEN, DIM, SEED = 8, 6, 5
#: Window and overlap in code points, and windows that are decoded together.
WINDOW, OVERLAP, TOGETHER = 256, 48, 768
#: Bounds of the sample that the network is fitted on: documents that are searched for spans (all equal texts are one), windows of each kind and of
#: none, and code points of a window.
SAMPLE_DOCS, SAMPLE_SPANS, SAMPLE_CLEAN, SAMPLE_WINDOW = 40_000, 300, 1500, 96
STEPS, BATCH = 700, 48
#: A span is added from this margin over having no span there (in nats), or from the largest seen in clean windows that were held out.
MARGIN = 6.0

Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: a name is as long as it can be and ends at an @, so that each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at - _LOCAL.match(text[done:at][::-1]).end()
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the rules by kind and start: code points, end exclusive. Linear in the length of the text."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        for m in _PHONE.finditer(text):
            if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


def _classes() -> np.ndarray:
    """Code point below 128 -> class (letters with their other case, small, middle and large digits, each other sign), and one for all others."""
    out, signs = np.zeros(129, np.uint8), {}
    for b in range(128):
        c = chr(b).lower()
        if "a" <= c <= "z":
            out[b] = 2 + ord(c) - ord("a")
        elif c.isdigit():
            out[b] = 28 if c <= "2" else 29 if c <= "5" else 30
        elif b > 32 and b < 127:
            out[b] = 31 + signs.setdefault(c, len(signs))
        else:
            out[b] = 1
    out[128] = 31 + len(signs)
    return out


CLASSES = _classes()
N_CLASSES = int(CLASSES.max()) + 1  # class 0 fills windows


def codes_of(text: str) -> np.ndarray:
    return CLASSES[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 128)]


def _allowed() -> np.ndarray:
    """Tag by next tag: a span begins after none, and goes on as its own kind until none follows."""
    ok = np.zeros((TAGS, TAGS), bool)
    ok[:, 0] = True
    for k in range(len(KINDS)):
        ok[0, 1 + 2 * k] = ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


ALLOWED = _allowed()


class Tagger:
    """Parameters, and gradients of the mean log loss of whole tag sequences. Both directions are computed side by side; gates are
    piecewise linear, which is several times cheaper than a logistic curve."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        p = {"e": rng.normal(0, 0.5, (N_CLASSES, DIM)), "x": rng.normal(0, 0.4, (2, DIM, 4 * HIDDEN)), "h": rng.normal(0, 0.3, (2, HIDDEN, 4 * HIDDEN)), "b": np.zeros((2, 1, 4 * HIDDEN)), "v": rng.normal(0, 0.3, (2 * HIDDEN, TAGS)), "c": np.zeros(TAGS), "a": np.zeros((TAGS, TAGS)), "s": np.zeros(TAGS)}
        p["b"][:, :, HIDDEN : 2 * HIDDEN] = 1  # gates: input, forget, output, new
        p["c"][0] = 2
        self.p, self.margin = {k: v.astype(np.float64) for k, v in p.items()}, MARGIN

    def _states(self, codes: np.ndarray):
        p, (n, width) = self.p, codes.shape
        both = np.stack([codes, codes[:, ::-1]])
        emb = p["e"][both]  # 2, n, width, DIM
        into = np.einsum("zntd,zdg->tzng", emb, p["x"]) + p["b"]
        h = c = np.zeros((2, n, HIDDEN))
        kept = []
        for t in range(width):
            g = into[t] + h @ p["h"]
            gate = np.clip(0.2 * g[:, :, : 3 * HIDDEN] + 0.5, 0, 1)
            new = np.tanh(g[:, :, 3 * HIDDEN :])
            before, c = c, gate[:, :, HIDDEN : 2 * HIDDEN] * c + gate[:, :, :HIDDEN] * new
            th = np.tanh(c)
            kept.append((h, before, gate, new, th))
            h = gate[:, :, 2 * HIDDEN :] * th
        hs = np.stack([k[0] for k in kept[1:]] + [h])  # width, 2, n, HIDDEN
        return emb, both, kept, np.concatenate([hs[:, 0], hs[::-1, 1]], axis=2)

    def emissions(self, codes: np.ndarray) -> np.ndarray:
        """(width, n, TAGS)"""
        return self._states(codes)[3] @ self.p["v"] + self.p["c"]

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p, (n, width) = self.p, codes.shape
        emb, both, kept, top = self._states(codes)
        e = top @ p["v"] + p["c"]
        trans = np.exp(np.where(ALLOWED, p["a"], -np.inf))
        # Forward and backward sums, scaled at every step.
        shift = e.max(axis=2, keepdims=True)
        x = np.exp(e - shift)
        alpha, beta, scale = np.empty_like(x), np.empty_like(x), np.empty((width, n, 1))
        for t in range(width):
            alpha[t] = x[t] * (np.exp(p["s"]) if t == 0 else alpha[t - 1] @ trans)
            scale[t] = alpha[t].sum(axis=1, keepdims=True)
            alpha[t] /= scale[t]
        beta[-1] = 1
        for t in range(width - 1, 0, -1):
            beta[t - 1] = (x[t] * beta[t]) @ trans.T / scale[t]
        rows, at = np.arange(n)[None, :], tags.T
        gold = np.take_along_axis(e, at[:, :, None], 2).sum() + p["s"][at[0]].sum() + p["a"][at[:-1], at[1:]].sum()
        loss = (np.log(scale).sum() + shift.sum() - gold) / n
        d = alpha * beta
        g = {"s": d[0].sum(axis=0)}
        pairs = np.einsum("tni,tnj->ij", alpha[:-1], x[1:] * beta[1:] / scale[1:]) * trans
        np.subtract.at(pairs, (at[:-1].ravel(), at[1:].ravel()), 1)
        np.subtract.at(g["s"], at[0], 1)
        d[np.arange(width)[:, None], rows, at] -= 1
        g["a"], g["v"], g["c"] = pairs, np.einsum("tnh,tnk->hk", top, d), d.sum(axis=(0, 1))
        dtop = d @ p["v"].T
        dhs = np.stack([dtop[:, :, :HIDDEN], dtop[::-1, :, HIDDEN:]], axis=1)
        dinto, dh, dc = np.empty((width, 2, n, 4 * HIDDEN)), 0.0, 0.0
        g["h"] = np.zeros_like(p["h"])
        for t in range(width - 1, -1, -1):
            h, before, gate, new, th = kept[t]
            i, f, o = gate[:, :, :HIDDEN], gate[:, :, HIDDEN : 2 * HIDDEN], gate[:, :, 2 * HIDDEN :]
            dh = dhs[t] + dh
            dc = dh * o * (1 - th * th) + dc
            z = dinto[t]
            z[:, :, :HIDDEN], z[:, :, HIDDEN : 2 * HIDDEN], z[:, :, 2 * HIDDEN : 3 * HIDDEN] = dc * new, dc * before, dh * th
            z[:, :, : 3 * HIDDEN] *= 0.2 * ((gate > 0) & (gate < 1))
            z[:, :, 3 * HIDDEN :] = dc * i * (1 - new * new)
            g["h"] += h.transpose(0, 2, 1) @ z
            dh, dc = z @ p["h"].transpose(0, 2, 1), dc * f
        g["b"] = dinto.sum(axis=(0, 2))[:, None]
        g["x"] = np.einsum("zntd,tzng->zdg", emb, dinto)
        g["e"] = np.zeros_like(p["e"])
        np.add.at(g["e"], both, np.einsum("tzng,zdg->zntd", dinto, p["x"]))
        return loss, {k: v / n for k, v in g.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = SEED) -> Tagger:
        """A fixed number of steps of Adam, whatever the sample's size."""
        rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for t in range(1, steps + 1):
            while len(order) < BATCH:
                order = np.append(order, rng.permutation(len(codes)))
            b, order = order[:BATCH], order[BATCH:]
            _, grads = self.gradients(codes[b], tags[b])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1, 5 / max(norm, 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.995 * v[k] + 0.005 * g * g
                self.p[k] = self.p[k] - 0.02 * 0.03 ** (t / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.995**t)) + 1e-8)
        return self

    def folded(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """The trained network for many windows: rows are hidden units, columns are windows; the gates' slope and offset are in the weights."""

    def __init__(self, net: Tagger):
        p = net.p
        gates = np.arange(4 * HIDDEN) < 3 * HIDDEN
        slope = np.where(gates, 0.2, 1.0)[:, None]
        self.weights = (np.concatenate([p["h"], p["x"]], axis=1).transpose(0, 2, 1) * slope).astype(np.float32)
        self.bias = (p["b"].transpose(0, 2, 1) * slope + np.where(gates, 0.5, 0.0)[:, None]).astype(np.float32)
        self.emb = np.ascontiguousarray(p["e"].T.astype(np.float32))
        # Scores relative to no span: of a tag over none, and of a transition over none after none.
        self.out = (p["v"] - p["v"][:, :1]).T.astype(np.float32)
        self.off = (p["c"] - p["c"][0]).astype(np.float32)[:, None]
        self.trans = np.where(ALLOWED, p["a"] - p["a"][0, 0], -np.inf).astype(np.float32)
        self.start = (p["s"] - p["s"][0]).astype(np.float32)[:, None]
        self.margin = net.margin

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """codes (n, width) -> scores of tags over none, (width, TAGS, n)."""
        n, width = codes.shape
        at = np.ascontiguousarray(codes.T)
        hs = np.empty((width, 2, HIDDEN, n), np.float32)
        x = np.zeros((2, HIDDEN + DIM, n), np.float32)
        c, g, tmp = np.zeros((2, HIDDEN, n), np.float32), np.empty((2, 4 * HIDDEN, n), np.float32), np.empty((2, HIDDEN, n), np.float32)
        h, k = x[:, :HIDDEN], HIDDEN
        gates, new = g[:, : 3 * k], g[:, 3 * k :]
        for t in range(width):
            np.take(self.emb, at[t], axis=1, out=x[0, k:], mode="clip")
            np.take(self.emb, at[width - 1 - t], axis=1, out=x[1, k:], mode="clip")
            np.matmul(self.weights, x, out=g)
            g += self.bias
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            np.tanh(new, out=new)
            c *= g[:, k : 2 * k]
            np.multiply(g[:, :k], new, out=tmp)
            c += tmp
            np.tanh(c, out=tmp)
            np.multiply(g[:, 2 * k : 3 * k], tmp, out=h)
            hs[t, 0], hs[width - 1 - t, 1] = h[0], h[1]
        return np.matmul(self.out, hs.reshape(width, 2 * HIDDEN, n)) + self.off

    def spans(self, codes: np.ndarray) -> list[tuple[int, str, int, int, float]]:
        """Best tag sequence of each window -> (window, kind, start, end, margin)."""
        e = self.scores(codes)
        width, _, n = e.shape
        best = np.empty_like(e)
        best[0] = e[0] + self.start
        to_none, begin = self.trans[:, 0][:, None], self.trans[0, 1::2][:, None]
        second, on = (np.array([self.trans[j + 2 * k, 2 + 2 * k] for k in range(len(KINDS))], np.float32)[:, None] for j in (1, 2))
        for t in range(1, width):
            was, now = best[t - 1], best[t]
            np.max(was + to_none, axis=0, out=now[0])
            np.add(was[0], begin, out=now[1::2])
            np.maximum(was[1::2] + second, was[2::2] + on, out=now[2::2])
            now[1:] += e[t, 1:]
        # Without a span the score is 0 throughout.
        some = np.flatnonzero(best[-1].max(axis=0) > 0)
        if not len(some):
            return []
        tags = np.empty((width, len(some)), np.int64)
        tags[-1] = best[-1][:, some].argmax(axis=0)
        for t in range(width - 1, 0, -1):
            tags[t - 1] = (best[t - 1][:, some] + self.trans[:, tags[t]]).argmax(axis=0)
        found = []
        for w, own in zip(some.tolist(), tags.T):
            kinds = np.where(own > 0, (own + 1) // 2, 0)
            cuts = np.flatnonzero(np.diff(np.concatenate([[0], kinds, [0]])))
            for s, t in zip(cuts.tolist(), cuts[1:].tolist()):
                if kinds[s]:
                    path = [0] * (s > 0) + own[s:t].tolist() + [0] * (t < width)
                    steps = float(sum(self.trans[a, b] for a, b in zip(path, path[1:])))
                    found.append((w, KINDS[kinds[s] - 1], int(s), int(t), steps + float(e[np.arange(s, t), own[s:t], w].sum())))
        return found


def windows_of(n: int) -> list[int]:
    """Starts of the windows that cover n code points; the last ends where they end."""
    last = max(0, n - WINDOW)
    return [*range(0, last, WINDOW - OVERLAP), last]


def reconciled(found: list[tuple[str, int, int, float, bool]]) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, margin, cut at a window's edge) of all windows of a text -> those that stay, by start.

    What an edge has cut goes together with what overlaps it in the same kind; of spans that overlap, the set with the greatest
    sum of margins stays (of equal sums the one that ends first).
    """
    joined: list[list] = []
    for kind, start, end, margin, cut in sorted(found, key=lambda s: (s[0], s[1], s[2])):
        last = joined[-1] if joined else None
        if last and last[0] == kind and start < last[2] and (cut or last[4]):
            last[2], last[3], last[4] = max(last[2], end), max(last[3], margin), last[4] and cut
        else:
            joined.append([kind, start, end, margin, cut])
    spans = sorted({(k, s, e): m for k, s, e, m, _ in joined}.items(), key=lambda x: (x[0][2], x[0][1], x[0][0]))
    ends = [key[2] for key, _ in spans]
    best: list[tuple[float, int | None, int]] = [(0.0, None, 0)]
    for k, ((_, start, _), margin) in enumerate(spans):
        before = int(np.searchsorted(ends, start, side="right"))
        take = best[min(before, k)][0] + margin
        best.append((take, k, min(before, k)) if take > best[-1][0] else (best[-1][0], None, k))
    out, at = [], len(spans)
    while at:
        _, k, at = best[at]
        if k is not None:
            out.append((*spans[k][0], spans[k][1]))
    return out[::-1]


_AT = re.compile(r"@|(?<![A-Za-z0-9])at(?![A-Za-z0-9])", re.I)
_DOT = re.compile(r"\.|(?<![A-Za-z0-9])dot(?![A-Za-z0-9])", re.I)
_LETTER = re.compile(r"[^\W\d_]")


def plausible(kind: str, span: str) -> bool:
    """What a span has to hold, whatever its way of writing: an email a name, one at sign and a dot later on, as signs or as words; an ip four numbers
    up to 255; a card 13 to 19 digits that pass Luhn; a phone 9 to 15 digits. Numbers hold no letters."""
    if kind == "email":
        at = list(_AT.finditer(span))
        return len(at) == 1 and at[0].start() > 0 and any(m.end() < len(span) for m in _DOT.finditer(span, at[0].end() + 1)) and len(span.split()) <= 7
    digits = _NO_DIGIT.sub("", span)
    if _LETTER.search(span) or not digits.isascii():
        return False
    if kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    return 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


def learned_spans(texts: Sequence[str], model: Decoder) -> list[list[tuple[str, int, int, float]]]:
    """Reconciled spans of each text from the margin on that are plausible, white space at the ends cut off."""
    found: list[list] = [[] for _ in texts]
    held: list[tuple[int, int, np.ndarray]] = []

    def decode() -> None:
        codes = np.zeros((len(held), max(len(c) for _, _, c in held)), np.uint8)
        for row, (_, _, c) in enumerate(held):
            codes[row, : len(c)] = c
        for w, kind, s, e, margin in model.spans(codes):
            doc, start, own = held[w]
            if s < len(own):
                e = min(e, len(own))
                cut = (s == 0 and start > 0) or (e == len(own) and start + e < len(texts[doc]))
                found[doc].append((kind, start + s, start + e, margin, cut))
        held.clear()

    # Windows of like width go together, so that short texts aren't filled up.
    for doc in sorted(range(len(texts)), key=lambda d: min(len(texts[d]), WINDOW)):
        codes = codes_of(texts[doc])
        for start in windows_of(len(codes)) if len(codes) else []:
            held.append((doc, start, codes[start : start + WINDOW]))
            if len(held) == TOGETHER:
                decode()
    if held:
        decode()
    out = []
    for text, own in zip(texts, found):
        kept = []
        for kind, s, e, margin in reconciled(own):
            while s < e and text[s].isspace():
                s += 1
            while s < e and text[e - 1].isspace():
                e -= 1
            if margin >= model.margin and plausible(kind, text[s:e]):
                kept.append((kind, s, e, margin))
        out.append(kept)
    return out


def all_spans(base: list[Span], learned: Sequence[tuple]) -> list[Span]:
    """The rules' spans, and the learned ones that overlap none of them; by kind as listed, then start."""
    new = [s[:3] for s in learned if all(s[2] <= b[1] or b[2] <= s[1] for b in base)]
    return sorted([*base, *new], key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def rewritten(kind: str, span: str, rng: np.random.Generator) -> str:
    """A span in a way of writing that its rule doesn't fit."""
    pick = lambda *ways: ways[int(rng.integers(len(ways)))]
    if kind == "email":
        name, _, domain = span.partition("@")
        at, dot = pick((" @ ", "."), ("(at)", "."), ("[at]", "."), (" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "))
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return span.replace(".", pick("[.]", " . ", "(.)"))
    digits = _NO_DIGIT.sub("", span)
    if kind == "card":
        return pick(".", "/", "_", " / ", "  ").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    return pick(f"00{digits}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"00{digits[:-10]} {digits[-10:-7]} {digits[-7:-4]} {digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}/{digits[-7:]}")


def tags_of(n: int, spans: Iterable[Span]) -> np.ndarray:
    tags = np.zeros(n, np.int64)
    for kind, s, e in spans:
        k = KINDS.index(kind)
        if not tags[s:e].any() and (s == 0 or not tags[s - 1]) and (e == n or not tags[e]):
            tags[s], tags[s + 1 : e] = 1 + 2 * k, 2 + 2 * k
    return tags


def _samples(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, a piece around one span of each kind, and one piece without a span, about signs and digits if there are any."""
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            seed = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big")
            base = base_spans(text)
            for kind in KINDS:
                own = [s for s in base if s[0] == kind and s[2] - s[1] < SAMPLE_WINDOW]
                if own:
                    _, s, e = own[seed % len(own)]
                    # No span is cut by the piece's ends.
                    at = max(0, s - seed % (SAMPLE_WINDOW - (e - s)))
                    at = max([at, *(b for _, a, b in base if a < at < b <= s)])
                    end = min([at + SAMPLE_WINDOW, *(a for _, a, b in base if e <= a < at + SAMPLE_WINDOW < b)])
                    inside = [(k, a - at, b - at) for k, a, b in base if a >= at and b <= end]
                    out.append((kind, seed & (1 << 62) - 1, text[at:end], [f"{k}:{a}:{b}" for k, a, b in inside]))
            marks = [m.start() for m in re.finditer(r"[0-9@+]", text)] if seed % 2 else []
            at = max(0, marks[seed % len(marks)] - seed % SAMPLE_WINDOW) if marks else seed % max(1, len(text) - SAMPLE_WINDOW)
            piece = text[at : at + SAMPLE_WINDOW]
            if piece and not any(a < at + SAMPLE_WINDOW and b > at for _, a, b in base):
                out.append(("", seed & (1 << 62) - 1, piece, []))
        cols = list(zip(*out)) if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], names=["kind", "draw", "piece", "spans"])


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS, steps: int = STEPS) -> Decoder | None:
    """Fit a network on spans of the rules in a bounded sample of docs; None if it has no span at all.

    Which texts are searched is decided by a hash of the text, about `sample` of them; of their pieces, SAMPLE_SPANS of each kind and
    SAMPLE_CLEAN without a span go to the driver. Half of the pieces with spans are taken as they stand, half rewritten. A fifth of
    the clean ones is held out, and the margin is set above what the network finds in them.
    """
    bounded_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(text.alias("text")).where(F.length("text") > 0)
    share = sample / max(1, rows.count())
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), "text"), 11).cast("double") / F.lit(float(1 << 53))
    found = rows.where(draw < share).mapInArrow(_samples, "kind string, draw long, piece string, spans array<string>").distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("draw", "piece"))
    taken = found.withColumn("place", place).where(F.col("place") <= F.when(F.col("kind") == "", SAMPLE_CLEAN).otherwise(SAMPLE_SPANS)).where(F.col("place") <= max(SAMPLE_CLEAN, SAMPLE_SPANS))
    pieces = sorted((r[0], r[1], r[2], tuple(r[3])) for r in taken.select("kind", "draw", "piece", "spans").collect())
    return fitted([(k, p, [(a, int(b), int(c)) for a, b, c in (s.split(":") for s in spans)]) for k, _, p, spans in pieces], steps)


def fitted(pieces: list[tuple[str, str, list[Span]]], steps: int = STEPS) -> Decoder | None:
    """(kind or empty, piece, spans in it) -> the trained network."""
    rng = np.random.default_rng(SEED)
    if not any(spans for _, _, spans in pieces):
        return None
    lines, held = [], []
    clean = 0
    for _, piece, spans in pieces:
        if not spans:
            clean += 1
            (held if clean % 5 == 0 else lines).append((piece, []))
            continue
        lines.append((piece, spans))
        out, new, at = "", [], 0
        for kind, s, e in sorted(spans, key=lambda x: x[1]):
            if s < at:
                continue
            out += piece[at:s]
            other = rewritten(kind, piece[s:e], rng)
            new.append((kind, len(out), len(out) + len(other)))
            out, at = out + other, e
        lines.append((out + piece[at:], new))
    codes, tags = np.zeros((len(lines), SAMPLE_WINDOW), np.uint8), np.zeros((len(lines), SAMPLE_WINDOW), np.int64)
    for row, (piece, spans) in enumerate(lines):
        n = min(len(piece), SAMPLE_WINDOW)
        codes[row, :n], tags[row, :n] = codes_of(piece)[:n], tags_of(len(piece), spans)[:n]
    model = Tagger().fit(codes, tags, steps).folded()
    false = [m for own in learned_spans([p for p, _ in held], _with_margin(model, 0.0)) for _, _, _, m in own]
    return _with_margin(model, max([MARGIN, *(1.2 * m for m in false)]))


def _with_margin(model: Decoder, margin: float) -> Decoder:
    model.margin = margin
    return model


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


ADDED = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]


def personal_data(docs: DataFrame, model: Decoder | None, text_col: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (spans of the rules), base_sha256 (of these spans), spans (theirs and the learned ones) and
    n_added (the learned ones) to every row of docs.

    A null text counts as empty: no spans. Each row is judged by itself, repeated ones alike; texts of any length are covered whole by
    windows; where spans of a kind tie, the earlier one stays. Columns of the added names are replaced, others may have any name and pass
    through; an empty table gives an empty result. Without a model (no labelled span in the sample) nothing is added to the rules.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = [c for c in docs.columns if c.lower() not in ADDED]
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"))
    shared = spark.sparkContext.broadcast(model)
    kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            learned = learned_spans(texts, model) if model else [[]] * len(texts)
            found = []
            for text, more in zip(texts, learned):
                base = base_spans(text)
                spans = all_spans(base, more)
                found.append((*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            cols = list(zip(*found)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["row", *ADDED])
        give_back()

    fields = [T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(ADDED, kinds)]
    return rows.mapInArrow(run, T.StructType([T.StructField("row", rows.schema["row"].dataType), *fields])).select("row.*", *ADDED)


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return personal_data(docs.select("doc_id", "text"), train(docs)).select("doc_id", *ADDED)


ORACLE: dict[str, str] = {}
