"""Secrets: patterns report known shapes, a character network judges all else that candidates hold.

A candidate is a run of 16 or more token characters with a digit and a letter. A small
convolutional network in numpy reads it in windows of up to 48 characters with the 24 before
and the 8 behind; a longer run has overlapping windows, 24 apart, the last one at its end, and
the highest probability of them is its own. It is trained on labelled findings: all windows of the
corpus's candidates, labelled by whether a base pattern covers them, and findings made by rule for
shapes that a corpus may lack. Equal windows count once, and the windows of one run weigh one
together. A held-out third calibrates the scores (Platt) and sets the threshold: the highest that
keeps ``RECALL`` of the labelled secrets. More than ``LABELLED`` windows of a label share that weight,
so that the made findings keep theirs. Such corpora are dealt by hash into parts of about ``LABELLED``
windows of either label, beside the made ones; in each epoch every part trains the common network, and
the mean of the parts is the next one. Base spans always stay; the network adds candidates beside them. A candidate with base spans
is read too, with U+0000 in the place of what they report, so that what they leave decides. A base
span of letters and digits whose word goes on beyond it stays readable: it may be a part of a secret.

Edge cases: a null text is an empty one without findings; repeated rows give equal findings;
candidates of any length are read whole, and their span
is the whole run; an empty table trains on the made findings alone; input columns named like
the output are replaced.
"""

from __future__ import annotations

import copy
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_or_empty

KINDS = ("assign", "access", "hex", "learned")
LABELLED = 2000
#: Parts at most that an epoch trains at once: the driver holds a network of 50 kB for each. Larger corpora have larger parts.
PARTS = 256
MADE = 3000
RECALL = 0.98
SEED = 20
#: Steps of the scores to one, as they are counted for the calibration of a corpus in parts.
GRID = 1024

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
BEFORE, BODY, AFTER, STEP = 24, 48, 8, 24
WIDTH = BEFORE + BODY + AFTER

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"]] = True


def _runs(member: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the runs of at least so many bytes."""
    if len(member) < least:
        return np.zeros((0, 2), np.int64)
    edge = np.flatnonzero(np.diff(np.r_[False, member, False].view(np.int8)))
    pairs = edge.reshape(-1, 2)
    return pairs[pairs[:, 1] - pairs[:, 0] >= least]


def context_of(text: str, start: int, end: int) -> str:
    """A whole candidate and its surroundings, padded with U+0000 to ``WIDTH`` characters at least."""
    return text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0") + text[start:end].ljust(BODY, "\0") + text[end : end + AFTER].ljust(AFTER, "\0")


def windows_of(context: str) -> Iterator[tuple[int, str]]:
    """Overlapping windows of ``WIDTH`` characters over the whole of a candidate: its place in the candidate, and the window."""
    last = len(context) - WIDTH
    for at in [*range(0, last, STEP), last]:
        yield at, context[at : at + WIDTH]


def outside(context: str, spans: list[int]) -> str:
    """The context with U+0000 for what base spans report in the candidate; ``spans`` by start, as in ``labelled_windows``."""
    pairs = [(a + BEFORE, b + BEFORE) for a, b in zip(spans[::2], spans[1::2], strict=True)]
    # Places where nothing reported lies before or behind.
    starts, ends, last = set(), set(), -1
    for a, b in pairs:
        if a > last:
            starts.add(a)
            ends.add(last)
        last = max(last, b)
    ends.add(last)
    letter = lambda i: context[i].isascii() and context[i].isalnum()
    parts, done = [], 0
    for a, b in pairs:
        if (a in starts and letter(a - 1) or b in ends and letter(b)) and context[a:b].isalnum():
            continue  # the word goes on
        if b > done:
            a = max(a, done)
            parts += [context[done:a], "\0" * (b - a)]
            done = b
    return "".join(parts) + context[done:]


def labelled_windows(context: str, spans: list[int], every: bool = False) -> list[tuple[str, bool]]:
    """``every`` labelled window of a candidate, or the one with the smallest checksum. ``spans``: start, end, start, ... of what base patterns cover in it.

    A window is a secret if its body holds 16 characters of such a span, or all of it; the others of a candidate with a span are not labelled.
    """
    windows = list(windows_of(context))
    if not spans:
        wanted = [w for _, w in windows]
    elif len(windows) == 1:
        wanted = [windows[0][1]] if any(min(b, BODY) - a >= min(16, b - a) for a, b in zip(spans[::2], spans[1::2], strict=True)) else []
    else:
        places = np.array([at for at, _ in windows])
        a, b = np.array(spans[::2], np.int64), np.array(spans[1::2], np.int64)
        need = np.minimum(16, b - a)
        # A span counts in the windows between two places: one running count over all of them.
        first, end = np.searchsorted(places, a + need - BODY, "left"), np.searchsorted(places, b - need, "right")
        some = first < end
        count = np.zeros(len(windows) + 1, np.int64)
        np.add.at(count, first[some], 1)
        np.add.at(count, end[some], -1)
        wanted = [w for (_, w), base in zip(windows, (np.cumsum(count[:-1]) > 0).tolist(), strict=True) if base]
    if wanted and not every:
        wanted = [min(wanted, key=_checksum)]
    return [(w, bool(spans)) for w in wanted]


def _checksum(window: str) -> tuple[int, str]:
    return zlib.crc32(window.encode("utf-8", "surrogatepass")), window


def findings(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[int, int, str, list[int]]]]:
    """Base spans (kind, start, end), and candidates (start, end, context, start and end of base spans within), in code points."""
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data, np.uint8)
    # Code points before each byte: one running count of the bytes that start one.
    before = None if len(data) == len(text) else np.concatenate([np.zeros(1, np.int64), np.cumsum((raw & 0xC0) != 0x80)])

    def points(runs: np.ndarray) -> list[tuple[int, int]]:
        return [(a, b) for a, b in (runs if before is None else before[runs]).tolist()]

    base = []
    lower = text.lower()
    if any(h in lower for h in _ASSIGN_HINTS):
        base += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        base += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    base += [("hex", *span) for span in points(_runs(_HEX[raw], 24))]
    base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    # Spans of one kind do not overlap, so each kind is passed once, beside the candidates.
    rows = [[x for x in base if x[0] == kind] for kind in KINDS[:3]]
    at = [0] * len(rows)
    candidates = []
    runs = _runs(_TOKEN[raw], 16)
    for (a, b), (s, e) in zip(runs.tolist(), points(runs), strict=True):
        body = data[a:b]
        if any(48 <= c <= 57 for c in body) and any(c > 64 for c in body):
            found = []
            for k, row in enumerate(rows):
                while at[k] < len(row) and row[at[k]][2] <= s:
                    at[k] += 1
                i = at[k]
                while i < len(row) and row[i][1] < e:
                    found.append((row[i][1], k, row[i][2]))
                    i += 1
            within = [p for x, _, y in sorted(found) for p in (max(x, s) - s, min(y, e) - s)]
            candidates.append((s, e, context_of(text, s, e), within))
    return base, candidates


def codes(windows: list[str]) -> np.ndarray:
    """One row of character codes per window; all beyond ASCII count as one."""
    rows = np.array([list(w.encode("latin-1", "replace")) for w in windows], np.int64).reshape(-1, WIDTH)
    return np.minimum(rows, 127)


@dataclass
class Network:
    """Embedding, one convolution, pooling by maximum and mean, a dense unit, then Platt scaling and a threshold."""

    embed: np.ndarray  # character, 8
    kernel: np.ndarray  # 5 * 8, filters
    bias: np.ndarray
    dense: np.ndarray  # 2 * filters
    shift: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5

    SPAN = 5

    @classmethod
    def start(cls, rng: np.random.Generator, filters: int = 24, size: int = 8) -> Network:
        draw = lambda *shape: rng.normal(0, (2 / shape[0]) ** 0.5, shape)
        return cls(rng.normal(0, 0.5, (128, size)), draw(cls.SPAN * size, filters), np.zeros(filters), draw(2 * filters, 1)[:, 0], np.zeros(1))

    def forward(self, x: np.ndarray):
        e = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH - self.SPAN + 1, -1)
        act = np.maximum(cols @ self.kernel + self.bias, 0)
        pooled = np.concatenate([act.max(1), act.mean(1)], 1)
        return cols, act, pooled, pooled @ self.dense + self.shift

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return self.calibrated(self.scores(x))

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 512])[3] for i in range(0, len(x), 512)])

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))

    def set_threshold(self, p: np.ndarray, weights: np.ndarray, recall: float) -> None:
        """The highest that so much of the labelled secrets reaches, of which these are the probabilities."""
        if not len(p):
            self.threshold = 0.5
            return
        order = np.argsort(p)
        below = np.cumsum(weights[order])
        self.threshold = float(min(0.99, p[order][min(np.searchsorted(below, (1 - recall) * below[-1], "right"), len(p) - 1)]))

    def highest(self, contexts: Iterable[str]) -> np.ndarray:
        """The highest probability of the windows of each candidate; those without a character of it in the body are not read."""
        best, owners, held = [], [], []

        def judge() -> None:
            for k, p in zip(owners, self.probability(codes(held)).tolist(), strict=True):
                best[k] = max(best[k], p)
            owners.clear()
            held.clear()

        for k, context in enumerate(contexts):
            best.append(0.0)
            for _, window in windows_of(context):
                if not window[BEFORE : BEFORE + BODY].strip("\0"):
                    continue
                owners.append(k)
                held.append(window)
                if len(held) == 512:
                    judge()
        judge()
        return np.array(best)

    def gradients(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray | float = 1.0) -> list[np.ndarray]:
        cols, act, pooled, z = self.forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) * weights / len(y)
        dp = dz[:, None] * self.dense[None, :]
        filters, steps = act.shape[2], act.shape[1]
        da = np.repeat(dp[:, None, filters:] / steps, steps, axis=1)
        rows = np.arange(len(x))[:, None]
        da[rows, act.argmax(1), np.arange(filters)[None, :]] += dp[:, :filters]
        da *= act > 0
        dcols = (da @ self.kernel.T).reshape(len(x), steps, self.SPAN, -1).transpose(2, 0, 1, 3).reshape(-1, self.embed.shape[1])
        read = np.concatenate([x[:, k : k + steps].ravel() for k in range(self.SPAN)])
        dembed = np.stack([np.bincount(read, d, len(self.embed)) for d in dcols.T], 1)
        return [dembed, np.einsum("bti,btf->if", cols, da, optimize=True), da.sum((0, 1)), pooled.T @ dz, np.array([dz.sum()])]


@dataclass
class Descent:
    """Adam: a network, the moments of its gradients and the steps so far."""

    net: Network
    first: list = field(default_factory=lambda: [0.0] * 5)
    second: list = field(default_factory=lambda: [0.0] * 5)
    steps: float = 0.0

    NAMES = ("embed", "kernel", "bias", "dense", "shift")

    def epoch(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray, order: np.ndarray) -> None:
        for at in range(0, len(order), 128):
            some = order[at : at + 128]
            self.steps += 1
            for i, g in enumerate(self.net.gradients(x[some], y[some], weights[some])):
                self.first[i] = 0.9 * self.first[i] + 0.1 * g
                self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
                move = self.first[i] / (1 - 0.9**self.steps) / (np.sqrt(self.second[i] / (1 - 0.999**self.steps)) + 1e-8)
                setattr(self.net, self.NAMES[i], getattr(self.net, self.NAMES[i]) - 0.004 * move)

    @classmethod
    def mean(cls, states: list[Descent], weights: list[float]) -> Descent:
        of = lambda values: sum(v * w for v, w in zip(values, weights, strict=True)) / sum(weights)
        net = Network(*(of([getattr(s.net, name) for s in states]) for name in cls.NAMES))
        return cls(net, *([of([getattr(s, kind)[i] for s in states]) for i in range(5)] for kind in ("first", "second")), of([s.steps for s in states]))


def train(windows: list[str], labels: list[bool], epochs: int = 12, seed: int = SEED, recall: float = RECALL, weights: list[float] | None = None) -> Network:
    """Adam on two thirds; the last third calibrates and sets the threshold."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(windows))
    x, y = codes([windows[i] for i in order]), np.array([labels[i] for i in order], float)
    share = np.ones(len(x)) if weights is None else np.array([weights[i] for i in order])
    held = len(x) // 3
    state = Descent(Network.start(rng))
    for _ in range(epochs):
        state.epoch(x, y, share, held + rng.permutation(len(x) - held))
    net = state.net
    z = net.forward(x[:held])[3]
    net.platt = _platt(z, y[:held], share[:held])
    p = net.probability(x[:held])
    secret = y[:held] == 1
    net.set_threshold(p[secret], share[:held][secret], recall)
    return net


def _platt(z: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and shift that fit the scores to the labels, with Platt's softened targets."""
    positive = (weights * y).sum()
    high, low = (positive + 1) / (positive + 2), 1 / (weights.sum() - positive + 2)
    goal, a, b = np.where(y == 1, high, low), 1.0, 0.0
    for _ in range(50):  # Newton
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -50, 50)))
        g, w = weights * (p - goal), weights * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(g * z).sum(), g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return float(max(a, 1e-3)), float(b)


def made_findings(n: int = MADE, seed: int = SEED) -> list[tuple[str, bool]]:
    """Windows of secrets and of harmless tokens in made-up surroundings, half of each.

    A quarter of the tokens are long chains (paths, dotted names, keys and values), with a secret among them or
    without. Of a secret's windows those with 16 of its characters or more count, and none are labelled harmless.
    """
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    upper, digits = letters.upper(), "0123456789"

    def some(alphabet: str, n: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))

    def prose(n: int) -> str:
        return " ".join(some(letters, int(k)) for k in rng.integers(2, 9, n))

    def secret() -> str:
        length, kind = int(rng.integers(20, 64)), int(rng.integers(0, 7))
        body = some(letters + upper + digits, length)
        return [body, "ghp_" + body[:36], "sk-" + body, some(letters + upper + digits + "+/", length) + "=", some(digits + "abcdef", length), "xox-" + body, some(letters + digits, length)][kind]

    def harmless() -> str:
        kind = int(rng.integers(0, 9))
        word = lambda: some(letters, int(rng.integers(3, 10)))
        number = lambda: str(int(rng.integers(1, 2030)))
        return [
            f"{word()}{number()}.{word()}.com",
            f"{word()}-{word()}-{number()}-{word()}",
            f"/{word()}/{word()}{number()}/{word()}.html",
            f"{word()}_{word()}_{number()}_{word()}",
            f"{number()}-{number()}-{number()}T{number()}-{word()}",
            f"v{number()}.{number()}.{number()}-{word()}.{number()}",
            f"{word()}{word()}{word()}{number()}",
            f"{word().upper()}-{number()}-{number()}-{number()}-{word()}",
            "".join(word().capitalize() for _ in range(4)) + number(),
        ][kind].ljust(16, "0")

    def chain() -> str:
        sep = "/._=-"[int(rng.integers(0, 5))]
        return sep.join(some(letters, int(rng.integers(2, 10))) + (some(digits, int(rng.integers(1, 5))) if rng.random() < 0.3 else "") for _ in range(int(rng.integers(4, 16)))) + sep

    leads = ["", "key: ", 'auth="', "Bearer ", "credential = ", "export KEY=", " ", "see ", "at ", "(", "https://", "file ", "id "]
    out = []
    for i in range(n):
        long = rng.random() < 0.25
        if i % 2:
            start, body = 0, chain() + str(int(rng.integers(1, 2030))) if long else harmless()
            end = 0
        else:
            lead, own, rest = (chain(), secret(), chain()) if long else ("", secret(), "")
            start, end, body = len(lead), len(lead) + len(own), lead + own + ("/" + rest if rest else "")
        text = prose(6) + " " + leads[int(rng.integers(0, len(leads)))]
        for at, window in windows_of(context_of(f"{text}{body} {prose(3)}", len(text), len(text) + len(body))):
            if i % 2 or min(end, at + BODY) - max(start, at) >= 16:
                out.append((window, i % 2 == 0))
    return out


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_CANDIDATES = "array<struct<start:long,end:long,context:string,base:array<int>>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base spans and candidates of every whole text."""

    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base, others = findings(text)
            rows.append(([dict(zip(("kind", "start", "end"), x, strict=True)) for x in base], [dict(zip(("start", "end", "context", "base"), x, strict=True)) for x in others]))
        return pd.DataFrame(rows, columns=["base", "candidates"])

    made: Column = F.pandas_udf(run, f"base {_SPANS}, candidates {_CANDIDATES}")(text_or_empty(text_col))
    return docs.select(F.col(f"`{id_col}`"), made.alias("f")).select(id_col, "f.base", "f.candidates")


def examples(found: DataFrame) -> DataFrame:
    """window, base, weight: all labelled windows, equal ones once, with the largest share that one has in its run."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for c in (c for row in batch["candidates"] for c in row):
                counted = Counter(labelled_windows(c["context"], list(c["base"]), every=True))
                whole = counted.total()
                for (window, base), n in counted.items():
                    rows.append((window, base, n / whole))
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["window", "base", "weight"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["window", "base", "weight"])

    every = found.select("candidates").mapInPandas(run, "window string, base boolean, weight double")
    return every.groupBy("window", "base").agg(F.max("weight").alias("weight"))


def fit(found: DataFrame, labelled: int = LABELLED) -> Network:
    """Train on all labelled windows of the corpus and the made findings; more than ``labelled`` of a label share its weight."""
    rows = cut(examples(found))
    counts = {r.base: (r.n, float(r.weight)) for r in rows.groupBy("base").agg(F.count("*").alias("n"), _total("weight")).collect()}
    parts = min(PARTS, max([1, *(-(-n // labelled) for n, _ in counts.values())]))
    if parts > 1:
        return train_parts(rows, counts, parts, labelled)
    drawn = [rows.where(F.col("base") == F.lit(label)).orderBy(F.xxhash64("window"), "window").collect() for label in (True, False)]
    every = [(r.window, r.base, r.weight) for part in drawn for r in part] + [(w, y, 1.0) for w, y in made_findings()]
    windows, labels, weights = map(list, zip(*every, strict=True))
    return train(windows, labels, weights=weights)


def _total(weight: str) -> Column:
    """A sum that does not depend on the order of the rows."""
    return F.sum(F.col(weight).cast("decimal(18,15)")).alias(weight)


def _held() -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), F.col("window")), F.lit(3)) == 0


def dealt(rows: DataFrame, counts: dict[bool, tuple[int, float]], parts: int, labelled: int) -> DataFrame:
    """part, window, base, weight of the rows that are not held out.

    A label with fewer than ``parts`` times ``labelled`` rows has fewer parts of its own, and each of them goes to several.
    Over all parts every row of a label has the same multiple of its weight, in the mean ``labelled`` a part, or all of a label with less.
    """
    made = []
    for label, (n, weight) in counts.items():
        own = min(parts, -(-n // labelled))
        first = F.pmod(F.xxhash64("window"), F.lit(own))
        among = F.sequence(first, F.lit(parts - 1).cast("long"), F.lit(own).cast("long"))
        share = F.col("weight") * F.lit(parts * min(weight, labelled) / weight) / F.size(among)
        made.append(rows.where((F.col("base") == F.lit(label)) & ~_held()).select(F.explode(among).alias("part"), "window", "base", share.alias("weight")))
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def train_parts(rows: DataFrame, counts: dict[bool, tuple[int, float]], parts: int, labelled: int, epochs: int = 12, seed: int = SEED, recall: float = RECALL) -> Network:
    """As ``train``, with each epoch in parts: all start from one state, and the next is their mean."""
    made = made_findings()
    order = np.random.default_rng(seed).permutation(len(made))
    x, y = codes([made[i][0] for i in order]).astype(np.uint8), np.array([made[i][1] for i in order], float)
    held = len(made) // 3

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        # Not by pandas, whose sort by two columns ends strings at U+0000.
        part = part.iloc[sorted(range(len(part)), key=list(zip(part["base"], part["window"], strict=True)).__getitem__)]
        rest = len(x) - held
        xs = np.concatenate([codes(list(part["window"])).astype(np.uint8), x[held:]])
        ys, weights = np.concatenate([part["base"].to_numpy(float), y[held:]]), np.concatenate([part["weight"].to_numpy(float), np.ones(rest)])
        return pd.DataFrame({"part": [part["part"].iloc[0]], "x": [xs.tobytes()], "y": [ys.tobytes()], "weight": [weights.tobytes()]})

    packed = cut(dealt(rows, counts, parts, labelled).repartition(parts, "part").groupBy("part").applyInPandas(pack, "part long, x binary, y binary, weight binary"))

    def epoch_of(state: Descent, epoch: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for part, xs, ys, ws in zip(batch["part"], batch["x"], batch["y"], batch["weight"], strict=True):
                    own, weights = copy.deepcopy(state), np.frombuffer(ws)
                    at = np.random.default_rng([seed, epoch, part]).permutation(len(weights))
                    own.epoch(np.frombuffer(xs, np.uint8).reshape(-1, WIDTH), np.frombuffer(ys), weights, at)
                    yield pd.DataFrame({"part": [part], "weight": [weights.sum()], "state": [pickle.dumps(own)]})

        return run

    state = Descent(Network.start(np.random.default_rng(seed)))
    for epoch in range(epochs):
        done = sorted(packed.mapInPandas(epoch_of(state, epoch), "part long, weight double, state binary").collect(), key=lambda r: r.part)
        state = Descent.mean([pickle.loads(r.state) for r in done], [r.weight for r in done])
    net = state.net

    def steps(z: np.ndarray) -> np.ndarray:
        return np.floor(np.clip(z, -64, 64) * GRID).astype(np.int64)

    def run(windows: pd.Series) -> pd.Series:
        return pd.Series(steps(net.scores(codes(list(windows)))))

    # Scores of the held-out windows by count; a step of them is below what the threshold tells apart.
    counted = rows.where(_held()).select("base", "weight", F.pandas_udf(run, "long")("window").alias("step")).groupBy("base", "step").agg(_total("weight")).collect()
    mass = Counter()
    for r in counted:
        mass[r.base, r.step] += float(r.weight) * min(counts[r.base][1], labelled) / counts[r.base][1]
    for step, label in zip(steps(net.scores(x[:held])).tolist(), y[:held].tolist(), strict=True):
        mass[label == 1, step] += 1
    keys = sorted(mass)
    label, step, weights = np.array([k[0] for k in keys], float), np.array([k[1] for k in keys], float), np.array([mass[k] for k in keys])
    net.platt = _platt((step + 0.5) / GRID, label, weights)
    net.set_threshold(net.calibrated(step[label == 1] / GRID), weights[label == 1], recall)
    return net


def scored(found: DataFrame, net: Network) -> DataFrame:
    """Add ``spans``: base spans and the candidates at or above the threshold outside of them, by start, then kind."""

    def run(lists: pd.Series) -> pd.Series:
        passed = (net.highest(outside(c["context"], list(c["base"])) for row in lists for c in row) >= net.threshold).tolist()
        out, at = [], 0
        for row in lists:
            flags = passed[at : at + len(row)]
            at += len(row)
            out.append([{"kind": "learned", "start": c["start"], "end": c["end"]} for c, ok in zip(row, flags, strict=True) if ok])
        return pd.Series(out)

    added = F.when(F.size("candidates") > 0, F.pandas_udf(run, _SPANS)("candidates")).otherwise(F.array().cast(_SPANS))
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    keyed = F.transform(F.concat("base", added), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.withColumn("spans", F.array_sort(keyed))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans), candidates and spans (base and learned) for every row."""
    found = cut(candidates(docs, id_col, text_col))
    return scored(found, fit(found))


def number(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
