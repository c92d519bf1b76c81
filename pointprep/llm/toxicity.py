"""Toxicity by a support vector machine over a subsequence string kernel with Nystroem landmarks.

The kernel counts the subsequences of three and four characters that two strings share, each
weighted by the length it spreads over, so characters put into or left out of an insult
lower the likeness but do not end it. Strings are the units of a sentence: its words, and
what short pieces side by side spell together. The kernel against some landmark strings, whitened
by their own kernel matrix, gives each unit a short vector on which a linear machine is
trained. A document is labelled as a whole, so training alternates between choosing the
sentence, and in it the unit, that witnesses a toxic document and fitting the machine.
A document's score is a logistic function of its most toxic unit.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from pointprep.llm.common import arrow_map

#: Labelled documents per class that the machine is trained on at most.
TRAIN_DOCS = 800
#: Landmarks, a third of them from clean text, and the longest of them.
LANDMARKS = 36
LANDMARK_CHARS = 10
#: Landmarks out of toxic text where no unit is sure to be toxic.
FEW = 8
#: Weight of one character of spread, and subsequence lengths.
DECAY = 0.6
ORDERS = (3, 4)
#: Pieces of up to so many characters may be parts of one word; so many in a row are also read together.
PIECE_CHARS = 3
PIECES = 4
#: Longer units are cut into windows of so many characters that overlap by half.
UNIT_CHARS = 24
#: Unit scores that a worker remembers before it starts anew.
CACHE_UNITS = 900_000
#: Units scored at a time.
BATCH = 1_024
#: Texts whose units are put together before they are scored.
TEXTS = 1_000
#: Score of a text without any unit.
FLOOR = -2.0

_UNIT = re.compile(r"[^\x20\x09-\x0D]+")
#: Marks are dropped wherever they stand in a word.
_MARKS = re.compile(r"[.,;:!?\"'()\[\]{}|%&*#$\-_+=/\\~^`@<>…«»]+")
_SENTENCE = re.compile(r"(?<=[.!?])[\x20\x09-\x0D]+|[\x0A\x0D]+")


def sentence_units(sentence: str) -> list[str]:
    """Lower-cased words without marks, and what short pieces side by side spell.

    Two to four neighbours of up to three characters form a unit too, and three and more single characters in a row
    form one however many they are, so an insult may be gapped by spaces.
    """
    words = _UNIT.findall(_MARKS.sub("", sentence.lower()))
    out = [w for w in words if 1 < len(w) <= UNIT_CHARS]
    if len(out) < len(words):
        run: list[str] = []
        for w in [*words, ""]:
            if len(w) == 1:
                run.append(w)
                continue
            if len(run) > 2:
                out += _windows("".join(run))
            run = []
            if len(w) > UNIT_CHARS:
                out += _windows(w)
    begin = 0
    for i, w in enumerate([*words, " " * UNIT_CHARS]):
        if len(w) > PIECE_CHARS:
            for a in range(begin, i - 1):
                out += ["".join(words[a:b]) for b in range(a + 2, min(a + PIECES, i) + 1)]
            begin = i + 1
    return out


def _windows(unit: str) -> list[str]:
    """A unit, or its windows if it is long."""
    half = UNIT_CHARS // 2
    return [unit[i: i + UNIT_CHARS] for i in range(0, max(1, len(unit) - half), half)]


def text_units(text: str) -> set[str]:
    return set(sentence_units(text))


def _codes(words: list[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(words), width), pad, np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [ord(c) for c in w]
    return out


def _raw_kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Unnormalised kernel of every row of ``left`` with every row of ``right``, each words of one length."""
    rows, width = left.shape
    cols, height = right.shape
    decay = np.float32(DECAY)
    total = np.zeros((rows, cols), np.float32)
    match = [[(left[:, i, None] == right[None, :, j]).astype(np.float32) for j in range(height)] for i in range(width)]
    # before[i][j]: decayed sum over shorter subsequences that end left of and above (i, j); None stands for 0.
    before: list[list] | None = None
    for order in range(1, max(ORDERS) + 1):
        above: list = [None] * height
        sums = []
        last = order == max(ORDERS)
        for i in range(width):
            sums.append([None, *above[:-1]])
            along, here = None, []
            for j in range(height):
                value = None
                if before is None:
                    value = match[i][j]
                elif before[i][j] is not None:
                    value = match[i][j] * before[i][j]
                if value is not None and order in ORDERS:
                    total += value
                if last:
                    continue
                # Along the row, then down the column.
                if along is None:
                    along = value
                else:
                    along = along * decay
                    if value is not None:
                        along += value
                if above[j] is None:
                    here.append(along)
                else:
                    cell = np.multiply(above[j], decay)
                    if along is not None:
                        cell += along
                    here.append(cell)
            if not last:
                above = here
        before = sums
    return total


class Subsequences:
    """All subsequences of up to four characters of some landmarks, as a trie with each one's weight in each landmark.

    A string walks down the trie from all its places at once, and only what is part of a landmark is followed. So its kernel
    values with all landmarks cost the few subsequences it shares with them and not a table for every pair of strings.
    """

    def __init__(self, marks: list[str]):
        letters = sorted(set("".join(marks)))
        self.letters = np.array([ord(c) for c in letters], np.int32)
        nodes: dict[tuple[int, int], int] = {}
        weights: list[dict[int, float]] = [{}, {}]
        number = {c: i + 1 for i, c in enumerate(letters)}
        for m, mark in enumerate(marks):
            codes = [number[c] for c in mark]
            ends = [(-1, 1, 1.0)]
            for depth in range(1, max(ORDERS) + 1):
                longer = []
                for at, node, w in ends:
                    for i in range(at + 1, len(codes)):
                        child = nodes.setdefault((node, codes[i]), len(weights))
                        if child == len(weights):
                            weights.append({})
                        v = w * (DECAY ** (i - at - 1) if at >= 0 else 1.0)
                        longer.append((i, child, v))
                        if depth in ORDERS:
                            weights[child][m] = weights[child].get(m, 0.0) + v
                ends = longer
        # Node 0 is the end of the road, node 1 the root; letter 0 is any that no landmark has.
        self.child = np.zeros((len(weights), len(letters) + 1), np.int32)
        for (node, letter), child in nodes.items():
            self.child[node, letter] = child
        self.weight = np.zeros((len(weights), len(marks)), np.float32)
        for node, per in enumerate(weights):
            for m, w in per.items():
                self.weight[node, m] = w

    def raw(self, codes: np.ndarray) -> np.ndarray:
        """Unnormalised kernel of each row, strings of one length as code points, with every landmark.

        Places are gone through in order, all rows at once; the fourth character is looked for only in rows that have come so far.
        """
        rows, width = codes.shape
        place = np.searchsorted(self.letters, codes)
        known = self.letters[np.minimum(place, len(self.letters) - 1)] == codes
        letters = np.ascontiguousarray(np.where(known, place + 1, 0).T.astype(np.int32))
        size = self.child.shape[1]
        flat = self.child.ravel()
        decay = np.float32(DECAY)
        out = np.zeros((rows, self.weight.shape[1]), np.float32)
        found: list[tuple[np.ndarray, np.ndarray, float]] = []
        for i in range(width):
            one = flat[size + letters[i]] * size
            for j in range(i + 1, width):
                two = flat[one + letters[j]] * size
                if not two.any():
                    continue
                for k in range(j + 1, width):
                    three = flat[two + letters[k]]
                    hit = np.flatnonzero(three)
                    if not len(hit):
                        continue
                    spread = decay ** (k - i - 2)
                    node = three[hit]
                    found.append((hit, node, spread))
                    start = node * size
                    for l in range(k + 1, width):
                        four = flat[start + letters[l][hit]]
                        last = np.flatnonzero(four)
                        if len(last):
                            found.append((hit[last], four[last], spread * decay ** (l - k - 1)))
        if found:
            row = np.concatenate([f[0] for f in found])
            node = np.concatenate([f[1] for f in found])
            w = np.repeat(np.array([f[2] for f in found], np.float32), [len(f[0]) for f in found])
            order = np.argsort(row, kind="stable")
            row = row[order]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[first]] = np.add.reduceat(self.weight[node[order]] * w[order, None], first, axis=0)
        return out


def kernel(words: list[str], marks: list[str], table: Subsequences | None = None) -> np.ndarray:
    """Squared cosine of the subsequence kernel; strings of one or two characters are like nothing."""
    out = np.zeros((len(words), len(marks)), np.float32)
    if table is not None:
        own_marks = np.array([float(_own_many(_codes([m], len(m), -2))[0]) for m in marks], np.float32)
    groups = []
    for height in sorted({len(m) for m in marks}) if table is None else ():
        at = [i for i, m in enumerate(marks) if len(m) == height]
        right = _codes([marks[i] for i in at], height, -2)
        groups.append((at, right, _own_many(right)))
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for width, at in by_length.items():
        if width < min(ORDERS):
            continue
        for k in range(0, len(at), BATCH):
            part = at[k: k + BATCH]
            left = _codes([words[i] for i in part], width, -1)
            if table is not None:
                raw = table.raw(left)
                some = np.flatnonzero(raw.any(axis=1))
                if len(some):
                    own = _own_many(left[some])
                    out[np.array(part)[some]] = raw[some] ** 2 / np.maximum(own[:, None] * own_marks[None, :], 1e-12)
                continue
            own = _own_many(left)
            for columns, right, own_right in groups:
                found = _raw_kernel(left, right) ** 2 / np.maximum(own[:, None] * own_right[None, :], 1e-12)
                out[np.ix_(part, columns)] = found
    return out


def _own_many(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row with itself, all rows at once; it is symmetric, so half of the table is enough."""
    rows, width = codes.shape
    decay = np.float32(DECAY)
    total = np.zeros(rows, np.float32)
    zero = np.zeros(rows, np.float32)
    columns = np.ascontiguousarray(codes.T)
    match = [[(columns[i] == columns[j]).astype(np.float32) for j in range(i + 1)] for i in range(width)]
    before: list[list[np.ndarray]] | None = None
    for order in range(1, max(ORDERS) + 1):
        sums = [[zero] * (i + 1) for i in range(width + 1)]
        for i in range(width):
            for j in range(i + 1):
                value = match[i][j] if before is None else match[i][j] * before[i][j]
                if order in ORDERS:
                    total += value if i == j else value + value
                if order < max(ORDERS):
                    side = sums[i][j + 1] if j < i else sums[i + 1][i]
                    sums[i + 1][j + 1] = value + decay * (side + sums[i + 1][j] - decay * sums[i][j])
        before = sums
    return total


def _spread(pool: list[str], value: np.ndarray, like: np.ndarray, size: int) -> list[str]:
    """The most valuable strings, each discounted by its likeness to those already taken."""
    out: list[str] = []
    novelty = np.ones(len(pool))
    for _ in range(min(size, len(pool))):
        i = int(np.argmax(value * novelty))
        out.append(pool[i])
        novelty = np.minimum(novelty, np.maximum(1 - np.sqrt(like[i]), 0) ** 2)
        novelty[i] = -1
    return out


class Machine:
    """Landmarks, the weight of each one's kernel value, an offset, and the logistic curve."""

    def __init__(self, marks: list[str], weights: np.ndarray, offset: float, slope: float = 1.0, shift: float = 0.0):
        self.marks, self.weights, self.offset, self.slope, self.shift = marks, weights, offset, slope, shift
        self.known: dict[str, float] = {}
        self.table: Subsequences | None = None

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "table": None}

    def unit_scores(self, units: list[str]) -> np.ndarray:
        if self.table is None:
            self.table = Subsequences(self.marks)
        return kernel(units, self.marks, self.table) @ self.weights + self.offset if units else np.empty(0)

    def learn(self, units: set[str]) -> None:
        """Score the units that are not remembered."""
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        fresh = sorted(units - self.known.keys())
        self.known.update(zip(fresh, self.unit_scores(fresh).tolist()))

    def margin(self, units: set[str]) -> float:
        return max(map(self.known.__getitem__, units), default=FLOOR)

    def probability(self, margin: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * margin + self.shift))))


def _fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps in the primal."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    penalty = ridge * np.eye(x1.shape[1])
    penalty[-1, -1] = 1e-9
    previous = None
    for _ in range(60):
        active = y * (x1 @ w) < 1
        if previous is not None and (active == previous).all():
            break
        xa, wa = x1[active], weight[active]
        w = np.linalg.solve(penalty + xa.T @ (xa * wa[:, None]), xa.T @ (wa * y[active]))
        previous = active
    return w[:-1], float(w[-1])


def train(documents: list[tuple[int, list[list[str]]]], prior: float) -> Machine:
    """Fit the machine on (label, sentences of units). ``prior`` is the share of toxic documents."""
    units = [{u for s in sentences for u in s} for _, sentences in documents]
    labels = np.array([y for y, _ in documents])
    found = {y: Counter(u for own, l in zip(units, labels) if l == y for u in own) for y in (0, 1)}
    n = {y: max(1, int((labels == y).sum())) for y in (0, 1)}

    def odds(u: str) -> float:
        return math.log((found[1][u] + 0.3) / n[1]) - math.log((found[0][u] + 0.3) / n[0])

    def evidence(u: str) -> float:
        """Twice the gain in log-likelihood if the unit is more frequent in toxic documents than in clean ones."""
        total = n[0] + n[1]
        both = found[0][u] + found[1][u]
        return 2 * sum(
            c * math.log(c * total / (size * part))
            for y in (0, 1)
            for c, part in ((found[y][u], both), (n[y] - found[y][u], total - both))
            for size in (n[y],)
            if c
        )

    # Among so many units that mean nothing, less than one is expected to stand out so much by chance.
    bar = 2 * math.log(max(2, len(found[1])))
    candidates = sorted((u for u, c in found[1].items() if 3 < len(u) <= LANDMARK_CHARS and c >= 3 and odds(u) > 1), key=lambda u: (-evidence(u), u))[:600]
    # With few labels nothing may be sure, then the likeliest serve.
    candidates = [u for u in candidates if evidence(u) > bar] or candidates[:FEW] or sorted(found[1])[:1]
    common = [u for u, _ in sorted(found[0].items(), key=lambda x: (-x[1], x[0])) if 2 < len(u) <= LANDMARK_CHARS][:3_000] or ["text"]
    if not candidates:
        return Machine(common[:1], np.zeros(1), -1.0, 1.0, math.log(max(prior, 1e-3) / (1 - min(prior, 0.999))))
    value = np.array([found[1][u] * odds(u) for u in candidates])
    marks = _spread(candidates, value, kernel(candidates, candidates), LANDMARKS * 2 // 3)
    # Of clean units, those most like an insult, so that they can be told from it.
    like = kernel(common, marks).max(axis=1) * np.sqrt([found[0][u] for u in common])
    marks += [common[i] for i in np.argsort(-like, kind="stable") if common[i] not in marks][: LANDMARKS - len(marks)]
    gram = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    whiten = vectors * (1 / np.sqrt(np.maximum(values, 1e-3)))
    names = sorted(set().union(*units) if units else [])
    number = {u: i for i, u in enumerate(names)}
    features = kernel(names, marks, Subsequences(marks)) @ whiten if names else np.zeros((0, len(marks)))
    sure = set(candidates)
    score = np.array([min(3.0, odds(u)) if u in sure else -1.0 for u in names])
    clean = np.array(sorted({number[u] for own, l in zip(units, labels) if l == 0 for u in own}), int)
    toxic = [[np.array([number[u] for u in s], int) for s in sentences if s] for y, sentences in documents if y == 1]
    toxic = [t for t in toxic if t]
    w, b = np.zeros(len(marks)), -1.0
    # Spelt apart or with one letter more, an insult stays one.
    spelt = [v for u in candidates[:60] for v in (u[:2] + "x" + u[2:], u[:3] + u[2:], u[:1] + "1" + u[1:])]
    extra = kernel(spelt, marks) @ whiten
    seeds = [number[u] for u in candidates]
    hard = clean[np.linspace(0, len(clean) - 1, min(len(clean), 20_000)).astype(int)] if len(clean) else clean
    for _ in range(5):
        # The sentence that holds the worst unit witnesses a toxic document; all toxic units near it count.
        # A document without a toxic unit has no witness: its label has another reason, which no string of it shows.
        witness = list(seeds)
        for sentences in toxic:
            worst = max(sentences, key=lambda s: score[s].max())
            witness += [int(i) for i in worst if score[i] >= max(0.0, score[worst].max() - 0.5)]
        x = np.concatenate([features[witness], extra, features[hard]])
        y = np.concatenate([np.ones(len(witness) + len(extra)), -np.ones(len(hard))])
        weight = np.concatenate([
            np.full(len(witness), 100 / len(witness)), np.full(len(extra), 20 / max(1, len(extra))), np.full(len(hard), 400 / max(1, len(hard)))
        ])
        w, b = _fit_linear(x, y, weight)
        score = features @ w + b
        # Clean units on the wrong side join the training rows.
        wrong = clean[np.argsort(-score[clean])[:2_000]] if len(clean) else clean
        hard = np.concatenate([hard, np.repeat(wrong, 5)])
    machine = Machine(marks, (whiten @ w).astype(np.float64), b)
    margins = np.array([max((score[number[u]] for u in own), default=FLOOR) for own in units])
    machine.slope, machine.shift = _logistic(margins, labels, prior)
    return machine


def _logistic(margin: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the curve, with classes weighted to the share of toxic documents."""
    share = max(labels.mean(), 1e-6) if len(labels) else 0.5
    weight = np.where(labels == 1, prior / share, (1 - prior) / max(1 - share, 1e-6))
    # Smoothed targets keep the curve finite where classes are apart.
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() + 5e-5 * w @ w)

    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + 1e-4 * w
        hessian = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        # Far from the best a whole step can jump over it and back for ever, so it is halved until it gains.
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return max(float(w[0]), 1e-3), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", limit: int = TRAIN_DOCS) -> Machine:
    """Train on at most ``limit`` labelled documents of each class, those with the smallest hash of the key.

    Rows whose label or text is null are left out. Only the chosen documents' units reach the driver.
    """
    known = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("key"), (F.col(label) > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts.get(1):
        return Machine(["text"], np.zeros(1), -1.0, 1.0, -5.0)
    prior = counts[1] / sum(counts.values())
    w = Window.partitionBy("y").orderBy(F.xxhash64("key"), "key")
    chosen = known.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit).drop("n")
    # At most twice ``limit`` rows.
    drawn = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").filter(F.col("text").isNotNull())

    def rows(batches: Iterator[dict]):
        for batch in batches:
            for k, y, t in zip(batch["key"].to_pylist(), batch["y"].to_pylist(), batch["text"]):
                sentences = [list(dict.fromkeys(sentence_units(s))) for s in _SENTENCE.split(t.as_py())]
                yield k, y, [s for s in sentences if s]

    found = arrow_map(drawn, rows, "key long, y int, sentences array<array<string>>", out_rows=200).orderBy("key", "y").toArrow()
    # Units repeat much, so each string is held once.
    documents = [
        (y, [[sys.intern(u) for u in s] for s in sentences.as_py()]) for y, sentences in zip(found["y"].to_pylist(), found["sentences"])
    ]
    return train(documents, prior)


_MACHINES: dict[int, Machine] = {}


def score_documents(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5) of every whole text.

    A null text counts as empty; a text without units gets the score of the lowest margin.
    Each row gives one row; only the text is an input of its score.
    """
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    mark = hash((tuple(machine.marks), machine.weights.tobytes(), machine.offset, machine.slope, machine.shift))

    def rows(batches: Iterator[dict]):
        if mark not in _MACHINES:
            _MACHINES.clear()
            _MACHINES[mark] = sent.value
        own = _MACHINES[mark]
        for batch in batches:
            keys, texts = batch[key].to_pylist(), batch[text]
            for at in range(0, len(keys), TEXTS):
                units = [text_units(t.as_py() or "") for t in texts[at: at + TEXTS]]
                own.learn(set().union(*units))
                for k, u in zip(keys[at: at + TEXTS], units, strict=True):
                    p = own.probability(own.margin(u))
                    yield k, p, int(p >= 0.5)

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(key, text), rows, f"{key} {kind}, score double, predicted int")


def held_out(key: str = "doc_id"):
    """Rows whose label is never learnt from: crc32 of the key as text leaves no rest by 5."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
