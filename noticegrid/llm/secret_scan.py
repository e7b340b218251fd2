"""Secret scans: fixed patterns, and a character convolutional network over every candidate."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm import batches
from noticegrid.session import materialise

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run would fail; a longer one is one match either way
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "net")
# Candidates: all runs of 12 or more characters of this class.
RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
# Plain words, also joined by marks: each in one case but for its first letter.
WORDS = re.compile(r"[+/_.=-]*(?:(?:[A-Z]?[a-z]+|[A-Z]+)(?:[+/_.=-]+|\Z))+")

SAMPLE_CANDIDATES = 6_000  # distinct labelled candidates that train the network, at most
HELD_OUT = 5  # one in so many sets the threshold
BINS = 256  # steps of a held-out margin's unit
MEMO = 100_000  # scored windows that a task keeps
LEFT, BODY, RIGHT = 16, 32, 8  # characters of a window before, in and after a candidate
RECALL = 0.99
SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_net bigint, n_candidates bigint"
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns' findings, in order; code points, end exclusive."""
    found = []
    lower = text.lower()
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def overlaps(spans: list[tuple[int, int, int]]):
    """A function of (start, end): whether any of the sorted spans overlaps that range."""
    starts, ends, last = [s for s, _, _ in spans], [], 0
    for _, _, end in spans:
        ends.append(last := max(last, end))

    def found(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and ends[before - 1] > start

    return found


def label_of(text: str, start: int, end: int, found) -> float | None:
    """1 for a candidate that overlaps a fixed finding, 0 for one of a known harmless shape, else None.

    Harmless shapes are mail addresses, numbers with their marks, words with few digits, and plain
    words without any. What is neither teaches nothing; the network decides on it.
    """
    if found(start, end):
        return 1.0
    body = text[start:end]
    digits = sum(map(str.isdigit, body))
    mail = "@" in text[max(0, start - 1):start] + text[end:end + 1]
    plain = 6 * digits < len(body) if digits else WORDS.fullmatch(body)
    return 0.0 if mail or plain or not re.search("[A-Za-z]", body) else None


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def windows(text: str, start: int, end: int) -> list[bytes]:
    """Windows of fixed length over a whole candidate: its parts with what stands around each."""
    out = []
    for at in range(start, end, BODY):
        before = text[max(0, at - LEFT):at].rjust(LEFT, "\0")
        body = text[at:min(end, at + BODY)]
        stop = at + len(body)
        after = text[stop:stop + RIGHT].ljust(RIGHT, "\0")
        out.append((before + body.ljust(BODY, "\0") + after).encode("ascii", "replace").replace(b"?", b"\x01"))
    return out


class Network:
    """Embedding, one convolution, maximum and mean over places, and a logistic output."""

    WIDTH, EMBED, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (128, self.EMBED))
        self.kernel = rng.normal(0, 0.15, (self.WIDTH * self.EMBED, self.FILTERS))
        self.shift = np.zeros(self.FILTERS)
        self.out = rng.normal(0, 0.1, 2 * self.FILTERS)
        self.bias = np.zeros(1)

    def params(self) -> list[np.ndarray]:
        return [self.embed, self.kernel, self.shift, self.out, self.bias]

    def _forward(self, codes: np.ndarray):
        vectors = self.embed[codes]
        places = codes.shape[1] - self.WIDTH + 1
        patches = np.concatenate([vectors[:, j:j + places] for j in range(self.WIDTH)], axis=2)
        active = np.maximum(patches @ self.kernel + self.shift, 0)
        top = active.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(active, top[:, None], 1)[:, 0], active.mean(axis=1)], axis=1)
        return patches, active, top, pooled, pooled @ self.out + self.bias[0]

    def margins(self, codes: np.ndarray, block: int = 2_000) -> np.ndarray:
        parts = [self._forward(codes[i:i + block])[-1] for i in range(0, len(codes), block)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def gradients(self, codes: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        patches, active, top, pooled, margin = self._forward(codes)
        wrong = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - y) / len(y)
        back = wrong[:, None] * self.out[None, :]
        places = active.shape[1]
        into = np.repeat(back[:, None, self.FILTERS:] / places, places, axis=1)
        rows, cols = np.arange(len(y))[:, None], np.arange(self.FILTERS)[None, :]
        into[rows, top, cols] += back[:, : self.FILTERS]
        into *= active > 0
        flat = into.reshape(-1, self.FILTERS)
        kernel = patches.reshape(-1, patches.shape[2]).T @ flat
        to_patch = (flat @ self.kernel.T).reshape(patches.shape)
        vectors = np.zeros((len(y), codes.shape[1], self.EMBED))
        for j in range(self.WIDTH):
            vectors[:, j:j + places] += to_patch[:, :, j * self.EMBED:(j + 1) * self.EMBED]
        embed = np.stack([np.bincount(codes.ravel(), vectors[:, :, e].ravel(), 128) for e in range(self.EMBED)], axis=1)
        return [embed, kernel, flat.sum(axis=0), pooled.T @ wrong, np.array([wrong.sum()])]


def fit_network(codes: np.ndarray, y: np.ndarray, *, epochs: int = 12, batch: int = 128, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on the log loss; every third window is seen without its surroundings, so that the
    candidate itself must tell."""
    net, rng, step = Network(seed), np.random.default_rng(seed), 0
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.params()]
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            rows, step = order[at:at + batch], step + 1
            seen, bare = codes[rows], np.flatnonzero(rng.random(len(rows)) < 1 / 3)
            seen[bare, :LEFT] = seen[bare, -RIGHT:] = 0
            lift = (1 - 0.9**step) / np.sqrt(1 - 0.99**step)
            for p, (m, s), g in zip(net.params(), moments, net.gradients(seen, y[rows])):
                m[...] = 0.9 * m + 0.1 * g
                s[...] = 0.99 * s + 0.01 * g**2
                p -= rate * m / lift / (np.sqrt(s) + 1e-8)
    return net


def calibrate(margins: np.ndarray, y: np.ndarray, recall: float, weight: np.ndarray | None = None) -> float:
    """The threshold on held-out findings: even odds by the calibrated curve, or lower where that
    would find less than ``recall`` of the positives; infinite without positives. Each margin
    counts ``weight`` times."""
    weight = np.ones(len(margins)) if weight is None else weight
    order = np.argsort(margins, kind="stable")
    order = order[y[order] > 0]
    if not len(order):
        return float("inf")
    upto = np.cumsum(weight[order])
    lowest = margins[order[np.searchsorted(upto, np.floor((1 - recall) * upto[-1]), side="right")]]
    return min(float(lowest), _even_odds(margins, y, weight))


def _even_odds(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 200) -> float:
    """The margin at which a logistic curve over the margins, fitted to held-out labels, is one half."""
    def loss(a, b):
        z = a * margins + b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * ((a - 1) ** 2 + b**2)

    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, w = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * margins).sum() + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        now = loss(a, b)
        while loss(a - da, b - db) > now and abs(da) + abs(db) > 1e-9:  # a full step can overshoot
            da, db = da / 2, db / 2
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return -b / a if a > 1e-6 else float("inf")


def codes_of(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, LEFT + BODY + RIGHT).astype(np.int64)


def labelled_candidates(docs: DataFrame) -> DataFrame:
    """``window, label``: the labelled candidates of all documents."""
    def make():
        def work(ids, texts):
            out = {"window": [], "label": []}
            for text in texts:
                found = overlaps(base_spans(text))
                for start, end in candidates(text):
                    label = label_of(text, start, end, found)
                    if label is not None:
                        out["window"].append(windows(text, start, end)[0])
                        out["label"].append(label)
            return out

        return work

    return batches.per_slice(docs, make, "window binary, label double")


def training_sample(rows: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of at most ``sample`` rows, least by a hash: a quarter each of positives and
    negatives with and without a digit, as plain words outnumber all others."""
    digit = F.substring("window", LEFT + 1, BODY).cast("string").rlike("[0-9]")
    parts = [
        rows.filter((F.col("label") == k) & (digit if d else ~digit)).orderBy(F.xxhash64("window"), "window").limit(sample // 4)
        for k in (1.0, 0.0) for d in (True, False)
    ]
    table = reduce(DataFrame.unionByName, parts).toArrow()
    codes = table.column("window").to_pylist()
    return codes_of(codes) if codes else np.zeros((0, LEFT + BODY + RIGHT), np.int64), table.column("label").to_numpy()


def margin_counts(rows: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(margin, label, number) of all rows, margins cut down to steps of 1 / BINS."""
    schema = pa.schema([("bin", pa.int64()), ("label", pa.float64()), ("n", pa.int64())])

    def run(parts):
        for batch in parts:
            if batch.num_rows:
                margin = net.margins(codes_of(batch.column(0).to_pylist()))
                bins = np.floor(np.clip(margin, -200, 200) * BINS).astype(np.int64)
                key, n = np.unique(np.stack([bins, batch.column(1).to_numpy().astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1].astype(float)), pa.array(n)], schema=schema)

    counts = rows.select("window", "label").mapInArrow(run, "bin bigint, label double, n bigint")
    # At most 400 * BINS steps for each label.
    table = counts.groupBy("bin", "label").agg(F.sum("n").alias("n")).orderBy("bin", "label").toArrow()
    return tuple(table.column(c).to_numpy() / k for c, k in (("bin", BINS), ("label", 1), ("n", 1)))


def train(docs: DataFrame, recall: float = RECALL, sample: int = SAMPLE_CANDIDATES):
    """(network, threshold): candidates of all documents are labelled; a bounded number of each label
    fits the network, and all of the held-out fifth set the threshold. Where one part has no
    positive, as with very few of them, both use all candidates."""
    # Distinct windows: copies of a document teach nothing more, and order must not depend on partitions.
    rows = materialise(labelled_candidates(docs).groupBy("window").agg(F.max("label").alias("label")))
    held = F.pmod(F.xxhash64(F.lit(1), "window"), F.lit(HELD_OUT)) == 0
    found = rows.filter("label = 1").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(held, 1)).alias("held")).first()
    if not found.n:
        return None, float("inf")
    apart = 0 < found.held < found.n
    net = fit_network(*training_sample(rows.filter(~held) if apart else rows, sample))
    margins, y, n = margin_counts(rows.filter(held) if apart else rows, net)
    return net, calibrate(margins, y, recall, n)


def secrets(docs: DataFrame, *, recall: float = RECALL, sample: int = SAMPLE_CANDIDATES) -> DataFrame:
    """Findings of every row in its whole text (see ``SCHEMA``).

    ``spans`` has the fixed patterns' findings and, as kind ``net``, every other candidate whose best
    window reaches the threshold; candidates that overlap a fixed finding add nothing. Spans are in
    order of their start, then of kind. A null or empty text has none. Where the patterns find
    nothing in the whole table, there is nothing to learn from and the network adds none. Repeated rows give a row each; an empty table gives none.
    """
    net, threshold = train(docs, recall, sample)

    def make():
        memo: dict[bytes, float] = {}

        def margins(parts):
            if len(memo) > MEMO:
                memo.clear()
            new = [w for w in dict.fromkeys(parts) if w not in memo]
            for at in range(0, len(new), 20_000):
                some = new[at:at + 20_000]
                memo.update(zip(some, net.margins(codes_of(some)).tolist()))
            return np.array([memo[w] for w in parts])

        def work(ids, texts):
            base = [base_spans(t) for t in texts]
            own, parts, count = [], [], []
            for i, (text, spans) in enumerate(zip(texts, base)):
                found = candidates(text)
                count.append(len(found))
                hit = overlaps(spans)
                for start, end in found if net is not None else ():
                    if not hit(start, end):
                        pieces = windows(text, start, end)
                        own.append((i, start, end, len(pieces)))
                        parts += pieces
            added = [[] for _ in texts]
            if parts:
                margin = margins(parts)
                starts = np.cumsum([0] + [k for *_, k in own])[:-1]
                for (i, start, end, _), best in zip(own, np.maximum.reduceat(margin, starts)):
                    if best >= threshold:
                        added[i].append((start, 3, end))
            return {
                "doc_id": ids, **{f"n_{KINDS[k]}": [sum(s[1] == k for s in b) for b in base] for k in range(3)},
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                "spans": [joined(sorted(b + a)) for b, a in zip(base, added)],
                "n_net": [len(a) for a in added], "n_candidates": count,
            }

        return work

    return batches.per_slice(docs, make, SCHEMA)
