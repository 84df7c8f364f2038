"""Quality classifier by co-training.

Two views of a document have a classifier each: the *text* view sees which words occur, the *page* view
sees metadata (language, source, size) and layout counts (characters by kind, lines, repetition) but no
words. They are fitted on a bounded sample of labelled documents. Then come rounds over the whole table: each view
scores every document, and those that it is confident of are pseudo-labels for the other. What they tell is
summed up in Spark as counts of good and of bad documents for each feature of the other view, all of them, and
becomes what that view's weights are drawn to when it is fitted again; words that no labelled document has get a
weight that way. How strongly they are drawn is chosen on a fold of the labelled documents, not at all being one
choice. At last each view is calibrated on labelled documents that neither was fitted on (Platt),
the calibrated log-odds are combined by a logistic model, and the threshold is set there as well; another fold, that
nothing was fitted or set on, measures the accuracy. Every document is then scored by the combination.

A document is good if its label has ``quality`` 1 and ``toxic`` 0. The only bounds are of the labelled sample (``Sizes``):
``labelled`` documents with ``entries`` distinct words in all; and words are told apart by ``BUCKETS`` hashes.

Defined results: a null or empty text has no words and zero counts; null metadata is a value of its own;
a null ``n_chars`` is counted. Labels of one ``doc_id`` that disagree count as the worse; labels with a
null are left out; of repeated rows of a labelled document one is a training row. If the sample lacks
good or bad documents nothing can be learned: every document is kept, with null scores. Ties at the threshold
are kept. Empty tables give empty results. Other columns are carried along and may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import byte_slices, least_hashed, release, release_driver, stage, tidy

#: Not word characters, and capitals, in bytes.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MARKS = [bytes([c]) for c in b"!%$*&#|.,?:;@=/<>()\"'-_\t"]
CAPITALS, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


#: Hashes that words are told apart by.
BUCKETS = 1 << 18


@dataclass(frozen=True)
class Sizes:
    """Bounds of what is fitted on."""

    labelled: int = 9_000
    entries: int = 8_000_000
    rounds: int = 2
    confident: float = 0.97
    min_documents: int = 5
    #: how many of the surest words are tried, of which a fold chooses
    words: tuple[int, ...] = (5, 10, 20, 50, 200, 1_000)
    strengths: tuple[float, ...] = (0.0, 0.1, 0.3, 1.0)
    bins: int = 8
    buckets: int = 256


def word_ids(text: str) -> set[int]:
    return {h % BUCKETS for h in map(zlib.crc32, set(text.encode().translate(WORDS).split()))}


def layout(text: str, n_chars: int | None) -> list[float]:
    raw = text.encode()
    n = max(1, len(raw))
    ws = raw.translate(WORDS).split()
    lines = [x for x in raw.split(b"\n") if x]
    long = sum(map(len, ws))
    return [
        len(text) if n_chars is None else n_chars,
        len(ws),
        long / max(1, len(ws)),
        max(map(len, ws), default=0),
        len(set(ws)) / max(1, len(ws)) * min(1.0, len(ws) / 50),
        len(lines),
        len(raw) / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        1 - len(raw.translate(None, CAPITALS)) / n,
        1 - len(raw.translate(None, DIGITS)) / n,
        *(raw.count(m) / n for m in MARKS),
    ]


def codes(lang, source, buckets: int) -> list[int]:
    """The buckets of the metadata that are names."""
    return [zlib.crc32(f"{k}={v}".encode()) % buckets for k, v in (("lang", lang), ("source", source))]


class Rows:
    """Documents as lists of feature numbers (all of value 1), stored end to end."""

    def __init__(self, lists: list[np.ndarray], size: int):
        self.sizes = np.array([len(x) for x in lists], np.int64)
        self.flat = np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(lists)), self.sizes)
        self.n, self.size = len(lists), size

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.flat, g[self.row], self.size)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Rows, y: np.ndarray, weight: np.ndarray, prior: np.ndarray | None = None, offset=0.0, penalty: float = 1.0, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows; the weights of features, which are drawn to ``prior``, and the constant. ``offset`` is added to
    the rows' log-odds."""
    prior = np.zeros(x.size) if prior is None else prior
    w, b = prior.copy(), 0.0
    m, v = np.zeros(x.size + 1), np.zeros(x.size + 1)
    l2, weight = penalty / weight.sum(), weight / weight.sum()
    for t in range(1, steps + 1):
        g = (sigmoid(x.dot(w) + b + offset) - y) * weight
        grad = np.append(x.back(g) + l2 * (w - prior), g.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        step = 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1]
        b -= step[-1]
    return w, b


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Coefficients (and constant) of the logistic model of y on the columns of z, by damped Newton steps."""
    x = np.column_stack([z, np.ones(len(y))])
    # Platt's targets keep separable scores finite
    up, down = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    c = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ c)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(c))
        c += np.clip(np.linalg.solve(h, x.T @ (t - p) - 1e-3 * c), -2, 2)
    return c


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Where the shares of good documents kept and of bad ones rejected have the greatest sum; in the
    middle of the range that is as good."""
    order = np.argsort(score)
    s, good = score[order], y[order] > 0
    # cutting below position k rejects the k lowest
    kept = 1 - np.append(0, np.cumsum(good)) / max(1, good.sum())
    out = np.append(0, np.cumsum(~good)) / max(1, (~good).sum())
    value = kept + out
    ok = np.append(True, s[1:] != s[:-1])
    value[: len(ok)][~ok] = -1
    top = np.flatnonzero(value == value.max())
    k = top[len(top) // 2]
    low = s[k - 1] if k else 0.0
    high = s[k] if k < len(s) else 1.0
    return float((low + high) / 2)


@dataclass
class Views:
    """Both classifiers and their calibration."""

    words: dict[int, float]
    words_const: float
    edges: list[np.ndarray]
    page: np.ndarray
    page_const: float
    buckets: int
    text_scale: np.ndarray
    page_scale: np.ndarray

    def text_logit(self, ids: set[int]) -> float:
        get = self.words.get
        return self.words_const + sum([get(h, 0.0) for h in ids])

    def page_logits(self, rows: Rows) -> np.ndarray:
        return self.page_const + rows.dot(self.page)

    def scaled(self, text: np.ndarray, page: np.ndarray) -> list[np.ndarray]:
        return [np.clip(c[0] * z + c[1], -12, 12) for c, z in ((self.text_scale, text), (self.page_scale, page))]


@dataclass
class Model:
    views: Views
    both: np.ndarray
    threshold: float
    accuracy: dict[str, float]

    def combine(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        zt, zp = self.views.scaled(text, page)
        return sigmoid(zt), sigmoid(zp), sigmoid(np.column_stack([zt, zp, np.ones(len(zt))]) @ self.both)


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of all values, and of those over the least one: most counts of a mark are zero."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    more = x[x > x.min()]
    return np.unique(np.concatenate([[x.min()], np.quantile(x, cuts), np.quantile(more, cuts) if len(more) else []]))


def page_rows(stats: np.ndarray, names: np.ndarray, edges: list[np.ndarray], buckets: int) -> Rows:
    """Each count as the number of its bin, each name as that of its bucket."""
    columns, at = [], 0
    for k, e in enumerate(edges):
        columns.append(at + np.searchsorted(e, stats[:, k], "left"))
        at += len(e) + 1
    for k in range(names.shape[1]):
        columns.append(at + names[:, k])
    table = np.column_stack(columns) if columns else np.zeros((len(stats), 0), np.int64)
    return Rows(list(table), at + buckets)


def telling(lists: list[np.ndarray], y: np.ndarray, sizes: Sizes) -> np.ndarray:
    """Words by how surely their shares of good and of bad documents differ in ratio, the surest first."""
    flat, label = np.concatenate(lists), np.repeat(y, [len(x) for x in lists])
    every, at = np.unique(flat, return_inverse=True)
    good, bad = np.bincount(at[label == 1], minlength=len(every)), np.bincount(at[label == 0], minlength=len(every))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    ratio = np.abs(np.log((good + 1) / (n1 + 2)) - np.log((bad + 1) / (n0 + 2)))
    sure = ratio - 2.5 * np.sqrt(1 / (good + 1) + 1 / (bad + 1))  # what the ratio is at least, most likely
    top = np.argsort(-sure, kind="stable")
    return every[top[(good + bad)[top] >= sizes.min_documents]]


def folds(lists: list[np.ndarray], n: int) -> np.ndarray:
    """A fold for each document, by one of its rare words: copies of a text mostly fall into the same fold,
    so that none of them tells another's label."""
    every, at, count = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
    rare, out, k = count <= max(2, 0.02 * len(lists)), np.zeros(len(lists), np.int64), 0
    mixed = (every * 2_654_435_761 + 12_345) % (1 << 32)
    for i, x in enumerate(lists):
        own = at[k : k + len(x)]
        k += len(x)
        own = own[rare[own]] if rare[own].any() else own
        out[i] = mixed[own].min() % 1_000_003 % n if len(own) else i % n
    return out


def among(lists: list[np.ndarray], words: np.ndarray) -> Rows:
    """The lists as numbers of the given words; other words are left out, which would only be learnt by heart."""
    words = np.sort(words)
    out = []
    for x in lists:
        at = np.minimum(np.searchsorted(words, x), max(0, len(words) - 1))
        out.append(at[words[at] == x] if len(words) else at[:0])
    return Rows(out, len(words))


def log_loss(y: np.ndarray, z: np.ndarray) -> float:
    p = np.clip(sigmoid(z), 1e-6, 1 - 1e-6)
    return float(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))))


def choose_words(lists: list[np.ndarray], y: np.ndarray, fitted: np.ndarray, check: np.ndarray, sizes: Sizes) -> np.ndarray:
    """So many of the surest words as predict a fold of labelled documents best."""
    ranked = telling([lists[i] for i in np.flatnonzero(fitted)], y[fitted], sizes)
    best = (np.inf, ranked)
    for k in sizes.words:
        some = ranked[:k]
        rows = among(lists, some)
        w, b = fit(rows, np.where(y > 0, 1.0, 0.0), fitted.astype(float))
        best = min(best, (log_loss(y[check], (rows.dot(w) + b)[check]), some), key=lambda x: x[0])
    return np.sort(best[1])


def prior_of(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """For features with counts (good, bad) in as many good and bad pseudo-labelled documents: the log ratio of their
    shares, less what may be chance."""
    good, bad = counts[:, 0], counts[:, 1]
    ratio = np.log((good + 1) / (documents[0] + 2)) - np.log((bad + 1) / (documents[1] + 2))
    sure = np.abs(ratio) - 2.5 * np.sqrt(1 / (good + 1) + 1 / (bad + 1))
    return np.sign(ratio) * np.maximum(sure, 0)


class Trainer:
    """The labelled sample: words (lists of ids), stats, names, y (1 good, 0 bad). Folds: 0 calibrates, 1 chooses,
    2 measures, the others are fitted on."""

    def __init__(self, sample: dict, sizes: Sizes):
        self.sizes, self.y = sizes, sample["y"]
        self.ids = sample["words"]
        fold = folds(self.ids, 7)
        self.held, self.check, self.test, self.fold = fold == 0, fold == 1, fold == 2, fold > 2
        self.ok = all((self.y[part] == k).any() for part in (self.held, self.check, self.fold) for k in (0, 1))
        if not self.ok:
            return
        self.vocabulary = choose_words(self.ids, self.y, self.fold, self.check, sizes)
        stats = sample["stats"]
        self.edges = [bin_edges(stats[self.fold, k], sizes.bins) for k in range(stats.shape[1])]
        self.page = page_rows(stats, sample["names"], self.edges, sizes.buckets)

    def _drawn(self, sides: list[tuple[Rows, np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, float, np.ndarray, float]]:
        """The views (rows, prior, offset) fitted with the strengths of their priors by which, combined, they predict
        the choosing fold best: weights, constant, log-odds of all rows, strength."""
        target, tried = (self.y > 0).astype(float), []
        for rows, prior, offset in sides:
            own = []
            for k in self.sizes.strengths if prior.any() or offset.any() else (0.0,):
                w, b = fit(rows, target, self.fold.astype(float), k * prior, k * offset)
                z = rows.dot(w) + b + k * offset
                scale = platt(z[self.held][:, None], self.y[self.held])
                own.append((k, np.clip(scale[0] * z + scale[1], -12, 12)))
            tried.append(own)
        best = None
        for first, zt in tried[0]:
            for second, zp in tried[1]:
                z = np.column_stack([zt, zp])
                both = platt(z[self.held], self.y[self.held])
                loss = log_loss(self.y[self.check], z[self.check] @ both[:2] + both[2])
                if best is None or loss < best[0]:
                    best = (loss, (first, second))
        out = []
        for (rows, prior, offset), k in zip(sides, best[1]):
            w, b = fit(rows, target, (self.fold | self.check).astype(float), k * prior, k * offset)
            out.append((w, b, rows.dot(w) + b + k * offset, k))
        return out

    def views(self, word_counts: np.ndarray, word_documents, page_counts: np.ndarray, page_documents) -> Views:
        """The views, drawn to what the pseudo-labelled documents of the whole table tell. Words that the labelled
        documents do not tell about enter with their prior weights alone."""
        told = prior_of(word_counts, word_documents) if word_documents.min() > 0 else np.zeros(BUCKETS)
        known, others = self.vocabulary, np.setdiff1d(np.flatnonzero(told), self.vocabulary)
        text, offset = among(self.ids, known), among(self.ids, others).dot(told[others])
        page_told = prior_of(page_counts, page_documents) if page_documents.min() > 0 else np.zeros(self.page.size)
        sides = [(text, told[known], offset), (self.page, page_told, np.zeros(len(self.ids)))]
        (w, c, zt, k), (wp, cp, zp, kp) = self._drawn(sides)
        self.strengths, self.logits = (k, kp), (zt, zp)
        scales = [platt(z[self.held][:, None], self.y[self.held]) for z in self.logits]
        weights = zip(np.concatenate([known, others]).tolist(), np.concatenate([w, k * told[others]]).tolist())
        words = {h: x for h, x in weights if abs(x) > 1e-6}
        return Views(words, float(c), self.edges, wp, float(cp), self.sizes.buckets, scales[0], scales[1])

    def model(self, views: Views) -> Model:
        z = np.column_stack(views.scaled(*self.logits))
        both = platt(z[self.held], self.y[self.held])
        score = sigmoid(np.column_stack([z, np.ones(len(z))]) @ both)
        cut = best_threshold(score[self.held], self.y[self.held])
        own, good = score[self.test], self.y[self.test] == 1
        share = lambda x: float(x.mean()) if len(x) else float("nan")
        return Model(views, both, cut, {"kept_good": share(own[good] >= cut), "rejected_bad": share(own[~good] < cut), "tested": int(self.test.sum()), "strengths": self.strengths})


def pseudo_counts(docs: DataFrame, views: Views, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over all documents: how many good and bad ones, as the page view is confident of, have each word, and as the text
    view is confident of, each feature of the page; and how many there are. A row for each feature and task at most
    is summed up in Spark, and a row for each feature comes back."""
    size = len(views.page)
    shared = docs.sparkSession.sparkContext.broadcast(views)
    rows = docs.select(*inputs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        total = np.zeros((BUCKETS + size + 2, 2), np.int64)  # the last two rows count documents
        for part in (p for b in batches for p in byte_slices(b, 0)):
            text, stats, names = _inputs_of(part, 0, v.buckets)
            words = [word_ids(t) for t in text]
            page = page_rows(stats, names, v.edges, v.buckets)
            zt, zp = v.scaled(np.array([v.text_logit(w) for w in words]), v.page_logits(page))
            for p, place in ((sigmoid(zp), 0), (sigmoid(zt), 1)):
                for label, sure in ((0, p >= sizes.confident), (1, p <= 1 - sizes.confident)):
                    at = np.flatnonzero(sure)
                    total[BUCKETS + size + place, label] += len(at)
                    if place == 0:
                        for i in at.tolist():
                            total[list(words[i]), label] += 1
                    else:
                        total[BUCKETS : BUCKETS + size, label] += np.bincount(page.flat[sure[page.row]], minlength=size)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["feature", "good", "bad"])

    each = rows.mapInArrow(tidy(run), "feature long, good long, bad long")
    found = each.groupBy("feature").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    total = np.zeros((BUCKETS + size + 2, 2), np.int64)
    total[found.column("feature").to_numpy()] = np.column_stack([found.column(c).to_numpy() for c in ("good", "bad")])
    return total[:BUCKETS], total[-2], total[BUCKETS:-2], total[-1]


def train(docs: DataFrame, sample: dict, sizes: Sizes) -> Model | None:
    trainer = Trainer(sample, sizes)
    if not trainer.ok:
        return None
    none = np.zeros(2, np.int64)
    views = trainer.views(np.zeros((BUCKETS, 2), np.int64), none, np.zeros((trainer.page.size, 2), np.int64), none)
    for _ in range(sizes.rounds):
        views = trainer.views(*pseudo_counts(docs, views, sizes))
    try:
        return trainer.model(views)
    finally:
        release()


def _inputs_of(part: pa.RecordBatch, first: int, buckets: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, counts and names of the columns that :func:`inputs` selects."""
    text, lang, source, n = (part.column(first + i).to_pylist() for i in range(4))
    text = [t or "" for t in text]
    stats = np.array([layout(t, c) for t, c in zip(text, n)], float)
    return text, stats, np.array([codes(a, b, buckets) for a, b in zip(lang, source)], np.int64)


def features(docs: DataFrame, key: list[str], buckets: int) -> DataFrame:
    """``key`` columns and the two views of each document."""
    rows = docs.select(*key, *inputs(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (p for b in batches for p in byte_slices(b, len(key))):
            text, stats, names = _inputs_of(part, len(key), buckets)
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[: len(key)],
                    pa.array([sorted(word_ids(t)) for t in text], pa.list_(pa.int64())),
                    pa.array(list(stats), pa.list_(pa.float64())),
                    pa.array(list(names), pa.list_(pa.int64())),
                ],
                names=[*key, "words", "stats", "names"],
            )

    extra = [("words", T.LongType()), ("stats", T.DoubleType()), ("names", T.LongType())]
    return rows.mapInArrow(tidy(run), T.StructType([*[rows.schema[c] for c in key], *[T.StructField(n, T.ArrayType(t)) for n, t in extra]]))


def inputs(docs: DataFrame, of: str = "") -> list:
    """What is read of a document; a column that is lacking is null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    column = (lambda c: F.col(of)[c]) if of else (lambda c: F.col(f"`{c}`"))
    has = docs.schema[of].dataType.names if of else docs.columns
    return [(column(c) if c in has else F.lit(None)).cast(t).alias(f"{c}_") for c, t in kinds.items()]


def learn(docs: DataFrame, labels: DataFrame, sizes: Sizes = Sizes()) -> Model | None:
    """The model of the labelled documents whose ids have the least hashes, and of all documents' pseudo-labels."""
    by_id = F.xxhash64("doc_id")
    known = (
        labels.select("doc_id", "quality", "toxic")
        .dropna()
        .groupBy("doc_id")
        .agg((F.min((F.col("quality") == 1).cast("int")) * F.min((F.col("toxic") == 0).cast("int"))).alias("y"))
    )
    # so many ids at most: small enough to broadcast, by the parameters
    chosen = least_hashed(known, sizes.labelled, "doc_id").orderBy(by_id, "doc_id").limit(sizes.labelled)
    rows = features(docs.join(F.broadcast(chosen), "doc_id").withColumn("y_", F.col("y")), ["doc_id", "y_"], sizes.buckets)
    # one row of each id, and no more of them than have so many words in all
    rows = stage(rows.groupBy("doc_id").agg(F.min(F.struct("y_", "words", "stats", "names")).alias("x")), "labelled")
    upto = F.sum(F.size("x.words")).over(Window.orderBy(by_id, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fits = rows.select("doc_id", upto.alias("upto")).filter(F.col("upto") <= sizes.entries).select("doc_id")
    found = rows.join(F.broadcast(fits), "doc_id").select("doc_id", "x.*").orderBy("doc_id").toArrow()
    if not found.num_rows:
        return None
    words = found.column("words").combine_chunks()
    flat, ends = words.values.to_numpy().astype(np.int64), words.offsets.to_numpy()
    array = lambda c, kind: found.column(c).combine_chunks().values.to_numpy().astype(kind).reshape(found.num_rows, -1)
    sample = {
        "words": [flat[a:b] for a, b in zip(ends[:-1], ends[1:])],
        "stats": array("stats", float),
        "names": array("names", np.int64),
        "y": found.column("y_").to_numpy(),
    }
    return train(docs, sample, sizes)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` as a column ``doc`` with ``p_text``, ``p_page`` (calibrated), ``score`` and ``keep``."""
    doc = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    none = F.lit(None).cast("double")
    if model is None:
        return doc.select("doc", none.alias("p_text"), none.alias("p_page"), none.alias("score"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = doc.select("doc", *inputs(doc, "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        v = m.views
        for part in (p for b in batches for p in byte_slices(b, 1)):
            text, stats, names = _inputs_of(part, 1, v.buckets)
            zt = np.array([v.text_logit(word_ids(t)) for t in text])
            pt, pp, s = m.combine(zt, v.page_logits(page_rows(stats, names, v.edges, v.buckets)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(pt), pa.array(pp), pa.array(s), pa.array(s >= m.threshold)],
                names=["doc", "p_text", "p_page", "score", "keep"],
            )

    out = T.StructType([doc.schema["doc"], *[T.StructField(c, T.DoubleType()) for c in ("p_text", "p_page", "score")], T.StructField("keep", T.BooleanType())])
    return rows.mapInArrow(tidy(run), out)


def classify(docs: DataFrame, labels: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    model = learn(docs, labels, sizes)
    release_driver()  # only now nothing holds the sample any more
    return score(docs, model)
