"""Toxicity by a subsequence string kernel with Nyström landmarks.

Training is multi-instance: labels mark documents, some wrongly, so a
document is a bag of sentences and a sentence a bag of *stretches*: a token, a
run of single letters set apart ("i d i o t", "i - d - i - o - t"), or
neighbouring tokens. A stretch's kernel features are all ordered triples of
its letters within a short span; a triple counts ``DECAY`` to the power of the
span, so characters put in between, a blank or a line end like any other,
weaken a match and don't break it. Characters that aren't letters take up room
and form no features. Landmarks are stretches of labelled sentences; a linear
support vector machine is fitted on the Nyström map of the normalised kernel.
As the kernel is an inner product of those features, the landmark expansion
folds into one weight per triple, which scores a stretch exactly as the kernel
sum over landmarks does.

The instances that stand for a toxic document are found in turns. First those
tokens that mark toxic documents beyond chance (a binomial tail over all that
were tested), and pairs of neighbouring words that mark the toxic documents in
which the machine then finds nothing; with the machine fitted on them, the stretch of each toxic document's worst sentence,
where the machine takes it for toxic and clean documents don't hold it. All
sentences of clean documents are clean; those stretches of theirs that the
machine takes for toxic join the other side each time. The logistic map to a
probability is fitted on the margins of the documents' worst sentences,
weighted to the corpus's own rates, and on gapped spellings of the stretches
that stand for toxic documents.

A text's score is that of its worst sentence, hence of its worst stretch.
Tokens and runs of letters are scored all; neighbouring tokens are scored
together where the letters that meet at the blank also meet in a stretch that
stands for toxic documents ("id iot" by "d i"), and no stretch goes beyond the
end of a sentence.

Defined cases: null and empty texts hold no stretch and get the calibrated
score of "no evidence", below the threshold; very long texts are scored whole,
long stretches in overlapping parts; repeated rows score alike; of several
worst stretches the last in code point order is named; labels that are null
are left out, a doc_id with several labels is toxic if any says so; without
rows of both labels every text gets that same score. Extra columns are
ignored (``score``) or kept (``drop_toxic``).
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.labelled import bounded_sample, fold, training_rows
from tallyloom.session import Scratch, bound_arrow_batches

#: Rows with crc32(doc_id) of this remainder are held out of training.
FOLDS, HELD_OUT = 4, 2
#: At most about so many labelled documents of each label are drawn (by a hash of doc_id) to train on.
SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
#: Clean units drawn to train on, and landmarks of the Nyström map.
CLEAN_UNITS, LANDMARKS = 16_000, 320
#: Turns in which instances are chosen anew, and clean stretches that join in one turn at most.
HARD_ROUNDS, HARD_UNITS = 2, 1500
#: Letters of a triple lie within so many characters; each character of the span counts so much.
SPAN, DECAY = 7, 0.75
#: Rows and triples that the fit works on at once.
BLOCK = 4096
#: Chance of one false seed among all units tested; a seed stands in so many toxic documents.
LEVEL, LEAST_DOCS = 0.05, 3
THRESHOLD = 0.3
#: Units whose score one worker keeps; then it starts anew.
KEPT_UNITS = 400_000

#: Characters that stand for letters.
FOLD = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"})
#: Longer units (base64, markup) are cut into overlapping stretches of this length.
UNIT_CHARS = 40
_LETTERS = 64
_SPACED = re.compile(r"(?<!\S)(?:\w[^\w\s]?\s+(?:[^\w\s.!?]\s+)?){2,}\w[^\w\s]?(?!\S)")
_LONE = re.compile(r"\s+(?:[^\w\s]\s+)?")
_END = ".!?"
_EDGE = ".,;:!?\"'()[]{}<>|%&*#$-_/\\"


def plain(unit: str) -> str:
    """A unit without marks at its edges."""
    core = unit.strip(_EDGE)
    return core if core.isalpha() else core.translate(FOLD)


def neighbours(tokens: list[str], junctions: frozenset[str]) -> list[str]:
    """Neighbouring tokens that meet at a known junction: each two, and each whole run of them."""
    out, begin, last = [], 0, -2
    for k in [*(k for k, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if f"{a[-2:]} {b[:2]}" in junctions), len(tokens)]:
        if k != last + 1:
            # The run before ends here; of two tokens it is there already.
            if last > begin:
                out.append(" ".join(tokens[begin : last + 2]))
            begin = k
        if k < len(tokens):
            out.append(f"{tokens[k]} {tokens[k + 1]}")
        last = k
    return out


def junctions_of(stretch: str) -> set[str]:
    """The letters on both sides of every place at which a stretch may be broken, as ``neighbours`` looks them up."""
    out = set()
    words = stretch.split()
    for a, b in zip(words, words[1:], strict=False):
        out.add(f"{a[-2:]} {b[:2]}")
    core = "".join(c for c in stretch if c.isalpha())
    if len(words) == 1 and len(core) >= 4:
        for p in range(1, len(core)):
            # Of a token of one letter only that letter is seen.
            out.update(f"{a} {b}" for a in {core[max(0, p - 2) : p], core[p - 1]} for b in {core[p : p + 2], core[p]})
    return out


def raw_units(text: str | None, junctions: frozenset[str] = frozenset()) -> set[str]:
    """Distinct stretches of a text, lower-case, as they stand there."""
    if not text:
        return set()
    low = text.lower()
    tokens = low.split()
    units = set(tokens)
    # Marks that stand alone between single letters take no room.
    units.update(_LONE.sub(" ", m[0]) for m in _SPACED.finditer(low))
    if junctions:
        units.update(neighbours(tokens, junctions))
    return units


def document_units(text: str | None, junctions: frozenset[str] = frozenset()) -> set[str]:
    """Distinct stretches of a text, plain."""
    units = set(map(plain, raw_units(text, junctions)))
    units.discard("")
    return units


def word_pairs(text: str) -> set[str]:
    """Each two neighbouring words of a sentence, plain."""
    tokens = text.lower().split()
    return {f"{x} {y}" for a, b in zip(tokens, tokens[1:], strict=False) if a[-1] not in _END and (x := plain(a)) and (y := plain(b))}


@cache
def _letter_codes() -> np.ndarray:
    """The code of every character: letters by themselves, foreign letters by remainder, -1 for what is no letter."""
    table = np.full(0x110000, -1, dtype=np.int8)
    for at in range(0x110000):
        c = chr(at)
        if "a" <= c <= "z":
            table[at] = at - 96
        elif c.isalpha():
            table[at] = 27 + at % (_LETTERS - 28)
    return table


def _codes(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes, places and unit numbers of all units' letters; code 0 marks each start and the last code each end."""
    size = np.fromiter(map(len, units), np.int64, len(units)) + 2
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    code = np.full(int(size.sum()), -1, dtype=np.int8)
    inner = np.ones(len(code), dtype=bool)
    inner[start] = inner[start + size - 1] = False
    code[inner] = _letter_codes()[points]
    code[start], code[start + size - 1] = 0, _LETTERS - 1
    of = np.repeat(np.arange(len(units)), size)
    place = np.arange(len(code)) - start[of]
    letter = code >= 0
    return code[letter].astype(np.int64), place[letter], of[letter]


def triples(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit number, triple and value of all kernel features; each unit's values have norm 1."""
    code, place, of = _codes([plain(u) for u in units])
    weight = DECAY ** (np.arange(SPAN + 1) + 1.0)
    keys, values = [], []
    n = len(code)
    high = (of << 18) | (code << 12)
    # Letters b apart lie at least b characters apart.
    for b in range(2, SPAN):
        if b >= n:
            break
        span = place[b:] - place[:-b]
        i = np.flatnonzero((of[b:] == of[:-b]) & (span < SPAN))
        ends, value = high[i] | code[i + b], weight[span[i]]
        for a in range(1, b):
            keys.append(ends | (code[i + a] << 6))
            values.append(value)
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    value = np.concatenate(values) if values else np.zeros(0)
    order = np.argsort(key)
    key, value = key[order], value[order]
    if not len(key):
        return key, key, value
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    value = np.add.reduceat(value, new)
    key = key[new]
    unit = key >> 18
    norm = np.sqrt(np.bincount(unit, weights=value * value, minlength=len(units)))
    return unit, key & ((1 << 18) - 1), value / norm[unit]


def stretches(unit: str) -> list[str]:
    """A unit whole, or in stretches that overlap by half where it is long."""
    if len(unit) <= UNIT_CHARS:
        return [unit]
    return [unit[at : at + UNIT_CHARS] for at in range(0, len(unit) - UNIT_CHARS // 2, UNIT_CHARS // 2)]


@dataclass
class Model:
    """``weights`` by triple, ``bias``, the logistic map from a margin to a score, and where neighbouring tokens are scored together."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    junctions: frozenset[str] = frozenset()

    def margins(self, units: list[str]) -> np.ndarray:
        """The machine's margin for each unit (its worst stretch)."""
        parts = [stretches(u) for u in units]
        flat = [p for ps in parts for p in ps]
        unit, triple, value = triples(flat)
        each = np.bincount(unit, weights=value * self.weights[triple], minlength=len(flat)) + self.bias
        if len(flat) == len(units):
            return each
        starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
        return np.maximum.reduceat(each, starts)

    def score(self, margin: float | None) -> float:
        low = self.shift - 4.0 if margin is None else self.slope * margin + self.shift
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, low)))))


class Scorer:
    """Scores texts with a model, keeping the margins of stretches it has met."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def _meet(self, units: list[str]) -> None:
        """Learn the margins of stretches; those that are alike once plain are worked out once."""
        known, plains = self.known, list(map(plain, units))
        new = sorted(set(plains) - known.keys() - {""})
        for at in range(0, len(new), 5_000):
            part = new[at : at + 5_000]
            known.update(zip(part, self.model.margins(part).tolist(), strict=True))
        known[""] = -math.inf
        known.update((u, known[p]) for u, p in zip(units, plains, strict=True))

    def worst(self, texts: list[str | None]) -> list[tuple[float | None, str | None]]:
        """Highest margin of each text, and the stretch that has it; of several the last by code points."""
        found = [raw_units(t, self.model.junctions) for t in texts]
        if len(self.known) > KEPT_UNITS:
            self.known = {}
        new = set().union(*found) - self.known.keys() if found else set()
        if new:
            self._meet(list(new))
        get = self.known.__getitem__
        out = []
        for units in found:
            each = list(map(get, units))
            top = max(each, default=-math.inf)
            out.append((top, max(plain(u) for u, m in zip(units, each, strict=True) if m == top)) if top > -math.inf else (None, None))
        return out


class Landmarks:
    """The landmarks' triples, and the normalised kernel with them."""

    def __init__(self, basis: list[str]) -> None:
        unit, triple, value = triples(basis)
        known, keys = np.unique(triple, return_inverse=True)
        self.size, self.index = len(basis), np.full(1 << 18, -1)
        self.index[triple] = keys
        self.land = np.zeros((max(1, len(known)), len(basis)))
        self.land[keys, unit] = value

    def kernel(self, units: list[str]) -> np.ndarray:
        """Units are rows, landmarks columns."""
        row, triple, value = triples(units)
        col = self.index[triple]
        hit = col >= 0
        row, col, value = row[hit], col[hit], value[hit]
        out = np.zeros((len(units), self.size))
        for at in range(0, len(row), BLOCK):
            part = slice(at, at + BLOCK)
            rows, first = np.unique(row[part], return_index=True)
            out[rows] += np.add.reduceat(self.land[col[part]] * value[part, None], first, axis=0)
        return out


def mapped(units: list[str], landmarks: Landmarks, whiten: np.ndarray, out: np.ndarray) -> None:
    """The Nyström map of units, a block at a time, into the rows of ``out``."""
    for at in range(0, len(units), BLOCK // 4):
        part = units[at : at + BLOCK // 4]
        out[at : at + len(part), : whiten.shape[1]] = landmarks.kernel(part) @ whiten


def _fit_svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine, by Newton steps on its active rows, which are summed up in blocks. The last column of ``z`` is ones."""
    n, m = z.shape
    w = np.zeros(m)
    penal = np.full(m, ridge * weight.sum() / n)
    penal[-1] = 1e-6
    for _ in range(20):
        left, right = np.diag(penal), np.zeros(m)
        for at in range(0, n, BLOCK):
            part, sign, heavy = z[at : at + BLOCK], y[at : at + BLOCK], weight[at : at + BLOCK]
            active = sign * (part @ w.astype(z.dtype)) < 1
            rows = part[active].astype(float)
            pulled = rows * heavy[active, None]
            left += pulled.T @ rows
            right += pulled.T @ sign[active]
        target = np.linalg.solve(left, right)
        done = np.allclose(target, w, atol=1e-6)
        w = target
        if done:
            break
    return w[:-1], float(w[-1])


def _spelt_around(unit: str, k: int, every: bool = False) -> list[str]:
    """Variants with characters put between the letters, as gapped insults have; ``every``: a letter put in at each place, not in the middle only."""
    core = unit.strip(_EDGE)
    if len(core) < 4:
        return []
    mark = ".*-_ "[k % 5]
    middle = len(core) // 2
    put_in = [core[:p] + "xzqw"[(k + p) % 4] + core[p:] for p in range(2, len(core))]
    return [mark.join(core), core[: middle - 1] + mark + core[middle - 1 :], *(put_in if every else put_in[middle - 2 : middle - 1])]


def tail(toxic: int, total: int, share: float) -> float:
    """Chance that at least ``toxic`` of ``total`` documents are toxic where the label has nothing to do with the unit."""
    logs = math.lgamma(total + 1)
    ks = range(toxic, total + 1)
    return min(1.0, sum(math.exp(logs - math.lgamma(k + 1) - math.lgamma(total - k + 1) + k * math.log(share) + (total - k) * math.log1p(-share)) for k in ks))


def pick_seeds(counted: list[tuple[str, int, int]], share: float, tested: int) -> list[tuple[str, int]]:
    """Units (with their toxic documents) that mark toxic documents beyond chance, all tests counted; the strongest first."""
    judged = sorted((tail(toxic, total, share), -toxic, unit) for unit, toxic, total in counted)
    return [(u, -t) for p, t, u in judged if p * max(tested, 1) < LEVEL]


def expansion(basis: list[str], coefficients: np.ndarray) -> np.ndarray:
    """One weight per triple, for a sum of kernels with landmarks."""
    bu, bt, bv = triples(basis)
    return np.bincount(bt, weights=bv * coefficients[bu], minlength=1 << 18)


def fit(seeds: list[tuple[str, int]], clean: list[str], hard: list[tuple[str, int]] = ()) -> Model:
    """The machine: ``seeds`` (with their toxic documents) against stretches of clean documents, each also with characters put between its letters.

    ``hard``: clean stretches (with their documents) that an earlier fit took for toxic.
    """
    usable = lambda units: [(u, n) for u, n in units if 0 < len(u) <= UNIT_CHARS]
    seeds, hard = usable(seeds), usable(hard)
    if not seeds or not clean:
        return Model(np.zeros(1 << 18), -1.0)
    basis = [u for u, _ in seeds[: LANDMARKS // 2]] + [u for u, _ in hard[: LANDMARKS // 4]]
    basis += clean[:: max(1, len(clean) // (LANDMARKS - len(basis)))][: LANDMARKS - len(basis)]
    basis = [b for b in dict.fromkeys(basis) if len(triples([b])[0])]
    landmarks = Landmarks(basis)
    value, vector = np.linalg.eigh(landmarks.kernel(basis))
    keep = value > 1e-6 * value.max()
    whiten = vector[:, keep] / np.sqrt(value[keep])
    good = seeds + [(s, n) for k, (u, n) in enumerate(seeds) for s in _spelt_around(u, k, True)]
    bad = clean + [u for u, _ in hard] + [s for k, u in enumerate(clean[::5]) for s in _spelt_around(u, k)]
    x = np.ones((len(good) + len(bad), whiten.shape[1] + 1), np.float32)
    mapped([u for u, _ in good], landmarks, whiten, x[: len(good)])
    mapped(bad, landmarks, whiten, x[len(good) :])
    y = np.concatenate([np.ones(len(good)), -np.ones(len(bad))])
    often = np.sqrt([n for _, n in good])
    against = np.ones(len(bad))
    against[len(clean) : len(clean) + len(hard)] = 3 * np.sqrt([n for _, n in hard])
    weight = np.concatenate([often * (0.5 * against.sum() / often.sum()), against])
    w, b = _fit_svm(x, y, weight)
    return Model(expansion(basis, whiten @ w), b, junctions=frozenset().union(*(junctions_of(u) for u, _ in seeds)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with Platt's smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = weight / weight.sum()
    a, c = 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        g, h = weight * (p - target), weight * p * (1 - p) + 1e-9
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, [(g * x).sum() + 1e-4 * a, g.sum()])
        a, c = a - np.clip(step[0], -1, 1), c - np.clip(step[1], -1, 1)
        if abs(step).max() < 1e-9:
            break
    return max(0.1, float(a)), float(c)


def _counted(rows: DataFrame, units) -> DataFrame:
    """unit, and in how many toxic documents and in how many at all it occurs; ``units`` gives a text's distinct ones."""

    def tell(batches):
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(units(t))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([y] * len(own), pa.int32())], names=["unit", "label"])

    return rows.mapInArrow(tell, "unit string, label int").groupBy("unit").agg(F.sum("label").cast("int").alias("toxic"), F.count("*").cast("int").alias("total"))


def _single(text: str) -> set[str]:
    return {s for u in document_units(text) for s in stretches(u)}


def _paired(text: str) -> set[str]:
    return {p for p in word_pairs(text) if len(p) <= UNIT_CHARS}


def _seeds(counted: DataFrame, share: float) -> list[tuple[str, int]]:
    """Stretches, with their toxic documents, that mark toxic documents beyond chance."""
    often = counted.filter(F.col("total") >= LEAST_DOCS)
    telling = often.filter((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") > 2 * share * F.col("total")))
    return pick_seeds([(r["unit"], r["toxic"], r["total"]) for r in telling.collect()], share, often.count())


def train(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Model:
    """Fit on a bounded sample of labelled rows: stretches are counted on executors, the telling ones come to the driver."""
    spark = docs.sparkSession
    bound_arrow_batches(spark)
    drawn, shares = bounded_sample(training_rows(docs, labels, "toxic", FOLDS, HELD_OUT), {1: sample_toxic, 0: sample_clean})
    scratch = Scratch(spark, "toxicity")
    rows = scratch.table(drawn.filter("text is not null").groupBy("text").agg(F.max("label").cast("int").alias("label")), "sample")
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(np.zeros(1 << 18), -1.0)
    share = n_toxic / (n_toxic + n_clean)
    single = scratch.table(_counted(rows, _single), "units")
    seeds = _seeds(single, share)
    idle = single.filter((F.col("total") > F.col("toxic")) & (F.col("toxic") <= 1.5 * share * F.col("total")))
    often = idle.orderBy(F.desc("total"), "unit").limit(CLEAN_UNITS // 2)
    spread = idle.orderBy(F.xxhash64("unit"), "unit").limit(CLEAN_UNITS // 2)
    clean = sorted({r[0] for r in often.select("unit").union(spread.select("unit")).collect()}, key=lambda u: zlib.crc32(u.encode()))
    model = fit(seeds, clean)
    worst = scratch.table(_margins(rows, model), "worst")
    # Pairs of words are looked for where no token tells anything.
    left = worst.filter("label = 0 or margin is null or margin < 0").select("text", "label")
    n_left = left.filter("label = 1").count()
    if n_left >= LEAST_DOCS:
        pairs = scratch.table(_counted(left, _paired).filter(F.col("total") >= LEAST_DOCS), "pairs")
        by_pairs = _seeds(pairs, n_left / (n_left + n_clean))
        if by_pairs:
            seeds = sorted(seeds + by_pairs, key=lambda x: (-x[1], x[0]))
            model = fit(seeds, clean)
            worst = scratch.table(_margins(rows, model), "worst")
    hard: dict[str, int] = {}
    chosen: dict[str, int] = dict(seeds)
    in_clean = idle.select("unit")
    for _ in range(HARD_ROUNDS if seeds else 0):
        before = len(hard), len(chosen)
        # Clean stretches that the machine takes for toxic ones, wherever they are among the sample's.
        taken = _unit_margins(idle.filter(F.col("total") >= 2), model).filter("margin > -0.5").orderBy(F.desc("margin"), "unit").limit(HARD_UNITS).collect()
        crossing = worst.filter("label = 0 and margin > -0.5 and instr(unit, ' ') > 0").groupBy("unit").agg(F.count("*").cast("int").alias("total")).orderBy(F.desc("total"), "unit").limit(HARD_UNITS).collect()
        hard |= {r["unit"]: r["total"] for r in taken} | {r["unit"]: r["total"] for r in crossing if r["unit"] not in chosen}
        # The instance that stands for each toxic document, in its worst sentence: a bounded sample has a bounded number of them.
        found = worst.filter("label = 1 and margin > 0").join(in_clean, "unit", "left_anti").groupBy("unit").agg(F.count("*").cast("int").alias("toxic")).collect()
        chosen |= {r["unit"]: r["toxic"] for r in found if r["unit"] not in chosen and r["unit"] not in hard and len(r["unit"]) <= UNIT_CHARS}
        if (len(hard), len(chosen)) == before:
            break
        model = fit(sorted(chosen.items(), key=lambda x: (-x[1], x[0])), clean, sorted(hard.items(), key=lambda x: (-x[1], x[0])))
        worst = scratch.table(_margins(rows, model), "worst")
    margins = np.array([(r["margin"], r["label"]) for r in worst.filter("margin is not null").select("margin", "label").collect()]).reshape(-1, 2)
    x, y = margins[:, 0], margins[:, 1]
    if 0 < y.sum() < len(y):
        weight = np.where(y == 1, 1 / shares[1], 1 / shares[0])
        # Gapped spellings of what stands for toxic documents count as toxic, too, together an eighth of what the documents do.
        gapped = [v for k, (u, _) in enumerate(sorted(chosen.items())) for v in _spelt_around(u, k, True)]
        if gapped:
            more = model.margins(gapped)
            x, weight = np.concatenate((x, more)), np.concatenate((weight, np.full(len(more), weight[y == 1].sum() / 8 / len(more))))
            y = np.concatenate((y, np.ones(len(more))))
        model.slope, model.shift = _logistic(x, y, weight)
    return model


def _unit_margins(units: DataFrame, model: Model) -> DataFrame:
    """unit, toxic, total and margin of a table of stretches."""
    known = units.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(known.value.margins(batch.column(0).to_pylist()), pa.float64())], names=["unit", "toxic", "total", "margin"])

    return units.select("unit", "toxic", "total").mapInArrow(judge, "unit string, toxic int, total int, margin double")


def _margins(rows: DataFrame, model: Model) -> DataFrame:
    """Worst margin, its stretch, label and text of each row of the sample."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        scorer = Scorer(known.value)
        for batch in batches:
            worst = scorer.worst(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in worst], pa.float64()), pa.array([u for _, u in worst], pa.string()), batch.column(1), batch.column(0)], names=["margin", "unit", "label", "text"])

    return rows.select("text", "label").mapInArrow(judge, "margin double, unit string, label int, text string")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and the worst unit of every document. No shuffle."""
    bound_arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        scorer = Scorer(known.value)
        for batch in batches:
            worst = scorer.worst(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([known.value.score(m) for m, _ in worst], pa.float64()), pa.array([u for _, u in worst], pa.string())], names=["doc_id", "score", "worst_unit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(judge, "doc_id long, score double, worst_unit string")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns. No shuffle."""
    bound_arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        scorer = Scorer(known.value)
        for batch in batches:
            yield batch.filter(pa.array([known.value.score(m) < threshold for m, _ in scorer.worst(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "worst_unit")
