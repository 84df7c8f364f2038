"""Secret scan: patterns for what is certain, a character convolutional network for the rest.

The patterns' findings are always reported. Besides, every run of 10 or more token characters that is not words (letters
in lower case, capitalised or in capitals, joined by hyphens and the like) is a candidate. A one-layer convolutional network,
in numpy, reads each whole candidate with the characters around it, whether it touches a pattern's finding or not;
candidates that it scores at or over the threshold are reported as kind ``model``, but for those that lie wholly inside a
pattern's finding, which is reported already.

The network is trained on labelled findings that every document gives: secrets of known make and harmless values
(identifiers, numbers, dates, words, paths), put into its text with and without a telling name before them, and all of
the patterns' findings in it, each with a harmless value more. Candidates that no pattern knows are not labelled. A fifth of the findings each, told by hash, are
held out and tested on. The others' findings are dealt by hash to groups; in every round all groups train on from one model, and
their models' mean, weighted by findings, is the next one. Scores of all findings held out are counted in Spark;
the counts calibrate the score (Platt) and set the threshold: the highest that keeps ``recall`` of
the secrets. Findings that neither was done on measure recall and precision.

Defined results: a null or empty text has no findings. Offsets are in code points, the end exclusive.
Texts and candidates are read whole, however long: a candidate's pooled features are the maxima over its
parts. Repeated rows and ties are handled row by row, empty tables give no rows, other columns are ignored.
Without documents to learn from, the contexts are empty. Rows that are alike in id and text give the same findings, each its own.
"""

from __future__ import annotations

import copy
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import byte_slices, drop_staged, stage, tidy

#: The patterns of the kinds that are certain, in the order of their listing.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
NAMES = ("password", "passwd", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{10,}")
MARKS = re.compile("[+/_=-]+")
LEFT, RIGHT, PART = 24, 8, 64


def certain(text: str) -> list[tuple[str, int, int]]:
    """The patterns' findings, kind by kind."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is the same whether shorter ones are matched and dropped or not
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CANDIDATE.finditer(text) if not is_words(m.group())]


def is_words(run: str) -> bool:
    """Whether a run is nothing but words, between marks if they are several."""
    return all([p.isalpha() and (p.islower() or p.isupper() or p[1:].islower()) for p in MARKS.split(run) if p])


def outside(spans: list[tuple[int, int]], sure: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The spans, in order, that lie wholly inside none of ``sure``: one walk through both."""
    own = sorted((s, e) for _, s, e in sure)
    out, k, reach = [], 0, -1
    for s, e in spans:
        while k < len(own) and own[k][0] <= s:
            reach = max(reach, own[k][1])
            k += 1
        if e > reach:
            out.append((s, e))
    return out


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def written(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in ordered(spans))


SYMBOLS = 100


CODES = np.array([96 if c == 32 or 9 <= c <= 13 else c - 31 if 32 < c < 127 else 98 for c in range(128)] + [97])


def encoded(text: str) -> np.ndarray:
    """Character numbers: 1 to 95 printable ASCII, 96 white space, 97 letters beyond, 98 the rest; 0 is padding."""
    return CODES[np.minimum(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), 128)]


def windows(text: str, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of characters, and which span each row belongs to: the left context, a part of the candidate, the
    right context. Each part of a long candidate has its true neighbours as context."""
    rows, owner = [], []
    for k, (s, e) in enumerate(spans):
        for a in range(s, e, PART):
            b = min(e, a + PART)
            row = np.zeros(LEFT + PART + RIGHT, np.int64)
            left = max(0, a - LEFT)
            own = encoded(text[left : b + RIGHT])
            row[LEFT - a + left : LEFT - a + left + len(own)] = own
            rows.append(row)
            owner.append(k)
    return (np.array(rows) if rows else np.zeros((0, LEFT + PART + RIGHT), np.int64)), np.array(owner, np.int64)


#: Findings that are made at least, however few documents there are: a thousand secrets then set the threshold.
LEAST = 10_000


@dataclass(frozen=True)
class Sizes:
    """How the network is trained: in groups of about ``findings`` findings, of which ``documents`` documents make as many.
    There are as many groups as it takes for all documents."""

    documents: int = 1_500
    findings: int = 3_000
    filters: int = 24
    width: int = 5
    dim: int = 12
    epochs: int = 8
    recall: float = 0.98
    rounds: int = 4

    def each(self, documents: int) -> int:
        """The findings that each of so many documents makes."""
        return max(-(-self.findings // self.documents), -(-LEAST // max(1, documents)))

    def groups(self, findings: int) -> int:
        return max(1, round(findings / self.findings))


#: Parts that a mean of models is rounded to, so that sums are the same in any order.
UNIT = 1 << 24


class Network:
    """Characters -> vectors -> convolution -> the greatest value of each filter -> logistic score."""

    def __init__(self, sizes: Sizes, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.width = sizes.width
        self.p = {
            "e": rng.normal(0, 0.3, (SYMBOLS, sizes.dim)),
            "c": rng.normal(0, (sizes.dim * sizes.width) ** -0.5, (sizes.dim * sizes.width, 2 * sizes.filters)),
            "cb": np.zeros(2 * sizes.filters),
            "o": rng.normal(0, 0.1, 2 * sizes.filters),
            "ob": np.zeros(1),
        }
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.p["e"][0] = 0
        self.scale, self.threshold = np.array([1.0, 0.0]), 0.5

    def flat(self) -> np.ndarray:
        """All parameters as whole numbers of units."""
        return np.rint(np.concatenate([x.ravel() for x in self.p.values()]).astype(np.float64) * UNIT).astype(np.int64)

    def with_mean(self, total: np.ndarray, n: int) -> Network:
        """A network of the mean of ``n`` times parameters, ``total`` in all."""
        out, at = copy.copy(self), 0
        out.p = {}
        for k, x in self.p.items():
            out.p[k] = (total[at : at + x.size] / (n * UNIT)).astype(np.float32).reshape(x.shape)
            at += x.size
        return out

    def filtered(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row by filter by place; half of the filters read the left context, half the candidate on."""
        half, out = self.p["c"].shape[1] // 2, []
        for part, f in ((rows[:, : LEFT + self.width - 1], slice(half)), (rows[:, LEFT:], slice(half, None))):
            x = self.p["e"][part]
            n, length, dim = x.shape
            view = np.lib.stride_tricks.sliding_window_view(x, (self.width, dim), axis=(1, 2))[:, :, 0]
            view = view.reshape(n * (length - self.width + 1), self.width * dim)
            h = view @ self.p["c"][:, f] + self.p["cb"][f]
            out.append(h.reshape(n, -1, half))
        return tuple(out)

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(np.concatenate([h.max(1) for h in self.filtered(rows)], axis=1), 0)

    def logits(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        best = np.zeros((n, len(self.p["o"])), np.float32)
        for k in range(0, len(rows), 256):
            np.maximum.at(best, owner[k : k + 256], self.pooled(rows[k : k + 256]))
        return (best @ self.p["o"] + self.p["ob"]).astype(np.float64)

    def train(self, rows: np.ndarray, y: np.ndarray, epochs: int, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        t, width, filters = 0, self.width, len(self.p["o"])
        place = np.arange(filters)[:, None] * width + np.arange(width)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), 64):
                part = rows[order[k : k + 64]]
                n = len(part)
                left, right = self.filtered(part)
                at = np.concatenate([left.argmax(1), LEFT + right.argmax(1)], axis=1)
                top = np.maximum(np.concatenate([left.max(1), right.max(1)], axis=1), 0)
                g = (1 / (1 + np.exp(-np.clip(top @ self.p["o"] + self.p["ob"], -30, 30))) - y[order[k : k + 64]]) / n
                grad = {"o": top.T @ g, "ob": np.array([g.sum()])}
                back = np.outer(g, self.p["o"]) * (top > 0)
                # how much each filter's greatest value is asked to change by each character at each place of the filter
                where = part[np.arange(n)[:, None, None], at[:, :, None] + np.arange(width)]
                asked = np.bincount((where * (filters * width) + place).ravel(), np.repeat(back.ravel(), width), SYMBOLS * filters * width)
                asked = asked.astype(np.float32).reshape(SYMBOLS, filters, width)
                c = self.p["c"].reshape(width, -1, filters)
                grad["c"] = np.tensordot(asked, self.p["e"], (0, 0)).transpose(1, 2, 0).reshape(self.p["c"].shape)
                grad["cb"] = back.sum(0)
                grad["e"] = np.tensordot(asked, c, ((1, 2), (2, 0)))
                grad["e"][0] = 0
                t += 1
                for name, d in grad.items():
                    m[name] += 0.1 * (d - m[name])
                    v[name] += 0.001 * (d * d - v[name])
                    self.p[name] -= 0.005 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)

    def score(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return self.scored(self.logits(rows, owner, n))

    def scored(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -30, 30)))


#: Names before a secret that the patterns do not know, and names before what is none.
TELLING = ["key", "auth", "pwd", "passphrase", "credential", "private_key", "client_id", "Bearer", "authorization", "signature", "pass", "access"]
HARMLESS = ["id", "file", "path", "version", "page", "ref", "order", "model", "isbn", "url", "name", "see"]


def make_secret(rnd: random.Random) -> str:
    kind = rnd.randrange(4)
    if kind == 0:
        return "".join(rnd.choices("0123456789abcdef", k=rnd.randint(16, 48)))
    if kind == 1:
        return "AKIA" + "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=rnd.randint(12, 20)))
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + ("+/" if kind == 2 else "_-")
    return "".join(rnd.choices(alphabet, k=rnd.randint(14, 64))) + rnd.choice(["", "", "=", "=="])


def make_harmless(rnd: random.Random, words: list[str]) -> str:
    kind, word = rnd.randrange(8), lambda: rnd.choice(words)
    if kind == 6:
        return "".join(rnd.choices("0123456789", k=rnd.randint(10, 20)))
    if kind == 7:
        return f"{word().capitalize()}{word().capitalize()}{word().capitalize()}"
    if kind == 0:
        return f"{word()}-{word()}-{rnd.randint(1, 2030)}"
    if kind == 1:
        return f"{word()}{word()}{word()}{rnd.randint(1, 99)}"
    if kind == 2:
        return f"/{word()}/{word()}/{rnd.randint(1, 10**6)}"
    if kind == 3:
        return f"{rnd.choice(['DE', 'FR', 'ES', 'GB'])}{''.join(rnd.choices('0123456789', k=rnd.randint(14, 22)))}"
    if kind == 4:
        return f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}T{rnd.randint(0, 23):02}"
    return f"v{rnd.randint(1, 20)}_{word()}_{rnd.randint(1, 10**5)}"


#: Of five parts of the findings, those that set the threshold and those that are tested on; the rest is trained on.
HELD, TEST, FOLDS = 0, 1, 5
#: Steps that a score is counted by, and the steps beyond which scores are counted as one.
FINE, FAR = 256, 1 << 15


def labelled_findings(doc_id, text: str | None, each: int) -> list[tuple[int, int, int, bytes]]:
    """(hash, fold, label, characters) of a document's findings: ``each`` made ones of either kind and all of the patterns'
    with a harmless one more for each, so that labels keep even. The same finding in a text's copies is in one fold.
    Characters are the rows of :func:`windows`."""
    text = text or ""
    crc = zlib.crc32(text.encode("utf-8", "replace"))
    own = zlib.crc32(repr(doc_id).encode("utf-8", "replace"), crc)
    rnd = random.Random(own)
    sure = certain(text)
    known = []
    if sure:
        spans = candidates(text)
        known = sorted(set(spans).difference(outside(spans, sure)))
    words: list[str] = []
    out = []

    def add(t: str, span: tuple[int, int], label: int) -> None:
        rows, _ = windows(t, [span])
        number = b"%d" % len(out)
        out.append((zlib.crc32(number, own), zlib.crc32(number, crc) % FOLDS, label, rows.astype(np.uint8).tobytes()))

    def make(label: int) -> None:
        if not label and not words:
            words.extend([w for w in rnd.choices(text.split() or [""], k=40) if w.isascii() and w.isalpha()] or ["word"])
        value = ""
        while not (CANDIDATE.fullmatch(value) and candidates(value)):
            value = make_secret(rnd) if label else make_harmless(rnd, words)
        at = rnd.randint(0, max(0, len(text) - 60))
        name = rnd.choice(TELLING if label else HARMLESS) if rnd.random() < 0.6 else ""
        lead = text[at : at + 40] + " " + (name + rnd.choice(["=", ": ", " = ", " ", ':"', '="']) if name else "")
        add(lead + value + " " + text[at + 40 : at + 60], (len(lead), len(lead) + len(value)), label)

    for _ in range(each):
        make(rnd.randrange(2))
    for span in known:
        add(text, span, 1)
        make(0)
    return out


def unpacked(chars: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The rows of findings, and which finding each row belongs to."""
    rows = np.frombuffer(b"".join(chars), np.uint8).reshape(-1, LEFT + PART + RIGHT)
    return rows.astype(np.int64), np.repeat(np.arange(len(chars)), [len(x) // rows.shape[1] for x in chars])


def trained(net: Network, found: Iterator[tuple[int, int, bytes]], epochs: int, most: int) -> tuple[int, np.ndarray]:
    """The sum of the models that groups of findings (group, label, characters), in order, make of ``net``, each counted by its rows. A
    group of far more rows than ``most`` makes several models, so that no more than that is held."""
    count, total = 0, np.zeros_like(net.flat())
    at, label, chars, size = None, [], [], 0

    def flush() -> None:
        nonlocal count, total, label, chars, size
        if chars:
            rows, owner = unpacked(chars)
            own = copy.deepcopy(net)
            own.train(rows, np.array(label, np.float32)[owner], epochs, at)
            total = total + len(rows) * own.flat()
            count += len(rows)
        label, chars, size = [], [], 0

    for group, y, x in found:
        if group != at or size >= 4 * most * (LEFT + PART + RIGHT):
            flush()
        at = group
        label.append(y)
        chars.append(x)
        size += len(x)
    flush()
    return count, total


def steps(net: Network, chars: list[bytes]) -> np.ndarray:
    """The steps that findings' scores are counted by."""
    return np.clip(np.floor(net.logits(*unpacked(chars), len(chars)) * FINE), -FAR, FAR).astype(np.int64)


def settled(net: Network, counts: dict[tuple[int, int, int], int], sizes: Sizes) -> tuple[Network, dict[str, float]]:
    """``net`` with its scale and threshold, by how many findings there are of each (fold, label, step), and how it does on
    findings that neither it nor its threshold was made on."""
    net = copy.copy(net)
    fold, label, step, n = np.array([(*k, n) for k, n in sorted(counts.items())], np.int64).reshape(-1, 4).T
    held, test, low = fold == HELD, fold == TEST, step / FINE
    net.scale = calibrate(low[held] + 0.5 / FINE, label[held], n[held])
    p = net.scored(low)
    secret = held & (label == 1)
    if secret.any():
        # in order of their scores, the first that is kept: one more is expected below it than there is
        order = np.argsort(p[secret], kind="stable")
        upto = np.cumsum(n[secret][order])
        lost = max(0, int((upto[-1] + 1) * (1 - sizes.recall)) - 1)
        net.threshold = float(p[secret][order][np.searchsorted(upto, lost, "right")])
    got = p >= net.threshold
    ratio = lambda a, b: float(n[a & b].sum() / max(1, n[b].sum()))
    return net, {
        "recall": ratio(got, test & (label == 1)),
        "precision": ratio(label == 1, test & got),
        "tested": int(n[test].sum()),
        "held": int(n[held].sum()),
    }


def epochs_of(sizes: Sizes) -> list[int]:
    """The epochs of each round."""
    return [x for x in np.diff(np.arange(sizes.rounds + 1) * sizes.epochs // sizes.rounds).tolist() if x]


def learn(texts: list[str], sizes: Sizes = Sizes()) -> tuple[Network, dict[str, float]]:
    """What :func:`fit` makes of a table of these texts, numbered, without Spark."""
    each = sizes.each(len(texts))
    found = [x for d, t in enumerate(texts or [""]) for x in labelled_findings(d, t, each)]
    train = [x for x in found if x[1] not in (HELD, TEST)]
    groups = sizes.groups(len(train))
    train = sorted((h % groups, h, y, x) for h, _, y, x in train)
    net = Network(sizes)
    for epochs in epochs_of(sizes):
        n, total = trained(net, ((g, y, x) for g, _, y, x in train), epochs, sizes.findings)
        net = net.with_mean(total, n) if n else net
    rest = [x for x in found if x[1] in (HELD, TEST)]
    step = steps(net, [x[3] for x in rest]).tolist() if rest else []
    return settled(net, Counter((x[1], x[2], z) for x, z in zip(rest, step)), sizes)


def fit(docs: DataFrame, sizes: Sizes = Sizes()) -> tuple[Network, dict[str, float]]:
    """The network, trained, calibrated and set on findings of every document, and how it does on findings that neither it
    nor its threshold was made on. The driver holds one model and counts of scores."""
    n = docs.count()
    if not n:
        return Network(sizes), {}
    each = sizes.each(n)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in byte_slices(b)):
            found = [x for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for x in labelled_findings(d, t, each)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names=["h", "fold", "label", "chars"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = stage(rows.mapInArrow(tidy(label), "h long, fold int, label int, chars binary"), "labelled_findings")
    train = found.filter(~F.col("fold").isin(HELD, TEST))
    groups = sizes.groups(train.count())
    train = train.select((F.col("h") % groups).alias("part"), "h", "label", "chars")
    tasks = min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    train = train.repartition(tasks, "part").sortWithinPartitions("part", "h", "label", "chars")
    net = Network(sizes)
    for epochs in epochs_of(sizes):
        net = next_model(net, train, epochs, sizes)
    rest = found.filter(F.col("fold").isin(HELD, TEST)).select("fold", "label", "chars")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in byte_slices(b, "chars")):
            step = pa.array(steps(net, part.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), step], names=["fold", "label", "step"])

    counts = rest.mapInArrow(tidy(count), "fold int, label int, step long").groupBy("fold", "label", "step").count().collect()
    drop_staged(found)
    return settled(net, {(r[0], r[1], r[2]): r[3] for r in counts}, sizes)


def next_model(net: Network, train: DataFrame, epochs: int, sizes: Sizes) -> Network:
    """The mean of the models that all groups make of ``net``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (p for b in batches for p in byte_slices(b, "chars"))
        rows = (x for p in parts for x in zip(*[p.column(k).to_pylist() for k in (0, 2, 3)]))
        n, total = trained(net, rows, epochs, sizes.findings)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros_like(net.flat())
        for b in batches:
            n += sum(b.column(0).to_pylist())
            for x in b.column(1).to_pylist():
                total = total + np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "total"])

    kind = "n long, total binary"
    r = train.mapInArrow(tidy(run), kind).repartition(1).mapInArrow(add, kind).collect()[0]
    return net.with_mean(np.frombuffer(bytes(r.total), np.int64), r.n) if r.n else net


def calibrate(z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 100) -> np.ndarray:
    """Platt's scale and shift, of scores that occur ``n`` times each. Higher scores stay higher."""
    up, down = n[y > 0].sum(), n[y <= 0].sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, c = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        c = c + np.clip(np.linalg.solve(h, x.T @ (n * (t - p))), -1, 1)
    return np.array([max(c[0], 1e-3), c[1]])


def snippets(text: str) -> list[str]:
    """Pieces of a text to learn from elsewhere than in :func:`fit`, which reads whole texts: one from a place that its hash tells, and its patterns'
    findings, with what is around them."""
    at = zlib.crc32(text.encode()) % max(1, len(text) - 199)
    return [text[at : at + 200], *(text[max(0, s - 40) : e + 20] for _, s, e in certain(text))]


def find(net: Network, text: str | None) -> list[tuple[str, int, int]]:
    """All findings in a text."""
    if not text:
        return []
    sure = certain(text)
    spans = outside(candidates(text), sure)
    if spans:
        p = net.score(*windows(text, spans), len(spans))
        sure = sure + [("model", s, e) for (s, e), x in zip(spans, p) if x >= net.threshold]
    return ordered(sure)


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def scan(docs: DataFrame, net: Network | None = None, sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, spans): every finding as kind, start and end, ordered by start and kind."""
    if net is None:
        net, _ = fit(docs, sizes)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in byte_slices(batch):
                found = [[dict(zip(("kind", "start", "end"), x)) for x in find(model, t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return rows.mapInArrow(tidy(run), T.StructType([docs.schema["doc_id"], T.StructField("spans", SPANS)]))
