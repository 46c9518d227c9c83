"""Secrets in texts: exact rules, and a small convolutional network over characters for the rest.

Candidates are runs of ``[A-Za-z0-9+/_.=-]`` of ``MIN_RUN`` characters or more that mix
digits and letters.  The network sees each candidate with its surroundings, a candidate
of more than ``INSIDE`` characters through windows that overlap by ``INSIDE - STEP`` and
cover all of it, of which the greatest probability counts: characters
are embedded, a convolution slides over them, the greatest response of each filter goes
to a logistic output.  It is written in numpy and learned by Adam on labelled findings:
generated ones, and at most ``MAX_FINDINGS`` distinct windows (those with the least hash)
of one document in ``SAMPLE_SHARE``, chosen by the text's hash from the whole table.
What a rule hits there is a secret, shown with the rule's keyword replaced by letters, as
the network is asked only about what no rule hits.  Of what no rule hits nobody knows
whether it is clean, so only its surroundings are learned from: each window's, whatever
its label, is shown once more around a generated clean run, and those of an open
candidate around a generated secret as well.  So no surroundings speak for either label.
On findings kept back, the output is calibrated (Platt) and the threshold set to the
highest that still has a recall of ``RECALL``, be it under one half.  Only weights are broadcast.

Base findings stay whatever the network says; it adds spans of kind ``model`` for
candidates that no base span meets.  Starts and ends count code points.

Defined results: a null text counts as empty and has no findings; null ids stay null;
repeated rows are scanned each by itself; without a candidate in the sample the network
learns from the generated findings alone; a text of any length is scanned in whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base rules.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "model")

MIN_RUN = 16
_RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_RUN},}}")
#: The sample that the network is fitted on: one text in so many, by hash, and of its findings so many at most.
SAMPLE_SHARE = 7
MAX_FINDINGS = 4000
RECALL = 0.95

ALPHABET = string.ascii_letters + string.digits + "+/_.=-\"': \n"
_CODE = {c: i + 2 for i, c in enumerate(ALPHABET)}  # 0: outside the text, 1: any other character
BEFORE, INSIDE, AFTER = 24, 48, 8
SIZE = BEFORE + INSIDE + AFTER
STEP = 24  # from one window of a long candidate to the next
WIDTH, EMBED, FILTERS = 5, 10, 24


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the rules, in order: leftmost, not overlapping within a kind; failing matches are dropped."""
    out = []
    runs = [m.span() for m in _RUN.finditer(text)]
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    for a, b in runs:  # both kinds of long match lie within a run
        part = text[a:b]
        if "AKIA" in part:
            out += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part) if m.end() - m.start() >= MIN_ACCESS]
        if b - a >= MIN_HEX:
            out += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part) if m.end() - m.start() >= MIN_HEX]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _RUN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".=-":
            b -= 1
        part = text[a:b]
        if b - a >= MIN_RUN and any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
            found.append((a, b))
    return found


def window(text: str, a: int, b: int) -> list[int]:
    """The codes of a candidate and what stands around it, each part at a place of its own."""
    code = lambda s: [_CODE.get(c, 1) for c in s]
    left, inside, right = code(text[max(0, a - BEFORE) : a]), code(text[a : min(b, a + INSIDE)]), code(text[b : b + AFTER])
    return [0] * (BEFORE - len(left)) + left + inside + [0] * (INSIDE - len(inside)) + right + [0] * (AFTER - len(right))


def places(a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a candidate that windows show: all of it, in overlapping parts of INSIDE characters if it is longer."""
    return [(s, s + INSIDE) for s in [*range(a, b - INSIDE, STEP), b - INSIDE]] if b - a > INSIDE else [(a, b)]


class CharCnn:
    """Embedding, convolution, maximum over places, logistic output; weights are plain arrays."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.w = {
            "e": rng.normal(0, 0.3, (len(ALPHABET) + 2, EMBED)),
            "c": rng.normal(0, 0.2, (WIDTH * EMBED, FILTERS)),
            "cb": np.zeros(FILTERS),
            "o": rng.normal(0, 0.2, FILTERS),
            "ob": np.zeros(1),
        }
        self.platt = (1.0, 0.0)
        self.threshold = 0.5

    def _forward(self, x: np.ndarray):
        e = self.w["e"][x]
        cols = np.concatenate([e[:, i : SIZE - WIDTH + 1 + i] for i in range(WIDTH)], 2)
        h = cols @ self.w["c"] + self.w["cb"]
        at = h.argmax(1)
        top = np.take_along_axis(h, at[:, None], 1)[:, 0]
        on = np.maximum(top, 0)
        return cols, at, top, on, on @ self.w["o"] + self.w["ob"]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 1024])[4] for i in range(0, len(x), 1024)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        cols, at, top, on, z = self._forward(x)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dtop = np.outer(dz, self.w["o"]) * (top > 0)
        picked = np.take_along_axis(cols, at[:, :, None], 1)  # row, filter, WIDTH * EMBED
        grads = {"o": on.T @ dz, "ob": np.array([dz.sum()]), "cb": dtop.sum(0), "c": np.einsum("nf,nfk->kf", dtop, picked)}
        back = np.einsum("nf,kf->nfk", dtop, self.w["c"]).reshape(-1, WIDTH, EMBED)
        where = x[np.arange(len(x))[:, None, None], at[:, :, None] + np.arange(WIDTH)]
        grads["e"] = np.zeros_like(self.w["e"])
        np.add.at(grads["e"], where.reshape(-1), back.reshape(-1, EMBED))
        return grads

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 5) -> CharCnn:
        """Adam on two thirds of the findings; the last third calibrates and sets the threshold."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        kept, learn = order[: len(y) // 3], order[len(y) // 3 :]
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(w) for k, w in self.w.items()}
        t = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
                t += 1
                for k, g in self._gradients(x[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, yk = self.margin(x[kept]), y[kept]
        a, b = 1.0, 0.0
        for _ in range(200):  # Platt: logistic regression of the label on the margin
            p = 1 / (1 + np.exp(-(a * z + b)))
            g = np.array([((p - yk) * z).mean() + 1e-3 * a, (p - yk).mean()])
            q = p * (1 - p)
            hess = np.array([[(q * z * z).mean() + 1e-3, (q * z).mean()], [(q * z).mean(), q.mean() + 1e-6]])
            step = np.linalg.solve(hess, g)
            a, b = a - 0.5 * step[0], b - 0.5 * step[1]
        self.platt = (float(a), float(b))
        positives = np.sort(self.probability(x[kept])[yk == 1])
        # The highest threshold with that recall on the findings kept back.
        self.threshold = float(positives[int(len(positives) * (1 - RECALL))]) if len(positives) else 1.1
        return self


def generated(n: int = 1500, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """Labelled findings of common shapes: (text, start, end, label)."""
    rnd = random.Random(seed)
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    b64, hexa, alnum = string.ascii_letters + string.digits + "+/", "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: pick(string.ascii_lowercase, rnd.randint(2, 9))
    out = []
    for i in range(n):
        secret = i % 2
        if secret:
            value = rnd.choice([
                lambda: pick(hexa, rnd.choice([20, 32, 40, 64])),
                lambda: pick(hexa.upper(), rnd.choice([32, 40])),
                lambda: pick(b64, rnd.randint(20, 60)),
                lambda: pick(alnum, rnd.randint(20, 48)),
                lambda: rnd.choice(["ghp_", "sk-", "xoxb-", "AKIA", "glpat-", "key-"]) + pick(alnum, rnd.randint(16, 40)),
                lambda: ".".join(pick(alnum + "_-", rnd.randint(16, 30)) for _ in range(3)),
            ])()
            lead = rnd.choice(["key = ", "auth: ", "Authorization: Bearer ", "pwd=", "", f"{word()} ", 'credential="', "access_key: "])
        else:
            value = rnd.choice([
                lambda: f"{word()}.{word()}.com/{word()}/{rnd.randint(1, 99999)}.html",
                lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}-{rnd.randint(10, 59)}-00Z",
                lambda: f"{word()}-{word()}-{word()}-{rnd.randint(1, 999)}",
                lambda: f"{word()}_{word()}_{rnd.randint(1, 99)}_{word()}",
                lambda: f"/{word()}/{word()}/{word()}{rnd.randint(0, 99)}/{word()}.txt",
                lambda: (word() + word() + word() + word())[:30] + str(rnd.randint(0, 9)),
                lambda: f"v{rnd.randint(0, 9)}.{rnd.randint(0, 99)}.{rnd.randint(0, 99)}-{word()}.{rnd.randint(0, 999)}",
                lambda: "=" * rnd.randint(14, 40) + word() + "1" + "=" * 4,
            ])()
            lead = rnd.choice([f"{word()} ", "see ", "http://", "file ", "", "(", f"{word()}\n"])
        value = value.ljust(MIN_RUN, "0" if secret else "1")
        before = f"{word()} {word()} " + lead
        out.append((f"{before}{value}{rnd.choice([' ', chr(10), '. ', chr(34), ' ' + word()])}", len(before), len(before) + len(value), secret))
    return out


def buried(n: int = 750, seed: int = 4) -> list[tuple[str, int, int, int]]:
    """Labelled windows of long runs, half of them with a secret after a clean beginning: (text, start, end, label)."""
    rnd = random.Random(seed)
    made = [x for x in generated(4 * n, seed + 1000) if x[2] - x[1] < INSIDE]
    secrets, clean = ([t[a:b] for t, a, b, y in made if y == label] for label in (1, 0))
    word = lambda: "".join(rnd.choice(string.ascii_lowercase) for _ in range(rnd.randint(2, 9)))
    out = []
    for i in range(n):
        path = ""
        while len(path) < rnd.randint(INSIDE, 3 * INSIDE):
            path += rnd.choice([word(), word(), f"{word()}-{word()}", f"{word()}{rnd.randint(0, 99)}", rnd.choice(clean).strip("/")]) + rnd.choice("///.")
        before = f"{word()} {rnd.choice(['http://', 'see ', word() + ' ', '(', ''])}{path}"
        secret = rnd.choice(secrets if i % 2 else clean).strip("/")
        text = before + secret + rnd.choice(["", f"/{word()}", f"/{word()}/{word()}.html"])
        at = (len(before), len(before) + len(secret))
        shown = [(s, e, labelled(s, e, [at] if i % 2 else [])) for s, e in places(len(before) - len(path), len(text))]
        shown = [x for x in shown if x[2] is not None]
        told = [x for x in shown if x[2] == i % 2] or shown
        out.append((f"{text} {word()}", *rnd.choice(told)))
    return out


def labelled(s: int, e: int, secrets: list[tuple[int, int]]) -> int | None:
    """1 if the window's part shows MIN_RUN characters of a secret or all of it, 0 if it meets none, else nothing."""
    shared = [(min(e, y) - max(s, x), y - x) for x, y in secrets]
    if any(k >= min(MIN_RUN, size) for k, size in shared):
        return 1
    return None if any(k > 0 for k, _ in shared) else 0


def masked(text: str, base: list[tuple[int, int, int]]) -> str:
    """The text with the rules' keywords replaced by as many letters, which follow from what stands behind them."""
    for start, kind, end in base:
        if kind == 2:
            continue
        a, b = ASSIGN.match(text, start).span(1) if kind == 0 else (start, start + 4)
        rnd = random.Random(text[b:end])
        text = text[:a] + "".join(rnd.choice(string.ascii_lowercase if kind == 0 else string.ascii_uppercase) for _ in range(b - a)) + text[b:]
    return text


def _value(text: str, span: tuple[int, int, int]) -> tuple[int, int]:
    """Where the secret of a base span stands."""
    start, kind, end = span
    return ASSIGN.match(text, start).span(2) if kind == 0 else (start, end)


def _labelled(batches):
    """Windows of a sample's candidates: label 1 if they show a base finding, 0 if they show none (open, not clean)."""
    for batch in batches:
        rows = []
        for t in batch.column("text").to_pylist():
            t = t or ""
            found = candidates(t)
            base = base_spans(t) if found else []
            secrets = [_value(t, x) for x in base]
            shown = masked(t, base)
            for a, b in found:
                for s, e in places(a, b):
                    label = labelled(s, e, secrets)
                    if label is not None:
                        rows.append((np.array(window(shown, s, e), np.uint8).tobytes(), label))
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32())], names=["codes", "label"])


def planted(codes: np.ndarray, values: list[str], seed: int = 6) -> np.ndarray:
    """Windows with what is inside them replaced by a value."""
    rnd = random.Random(seed)
    out = codes.copy()
    for row in out:
        value = rnd.choice(values)[:INSIDE]
        row[BEFORE : BEFORE + INSIDE] = [_CODE.get(c, 1) for c in value] + [0] * (INSIDE - len(value))
    return out


def train(docs: DataFrame) -> CharCnn:
    sample = docs.select(F.col("text").cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_SHARE)) == 0)
    found = sample.mapInArrow(_labelled, "codes binary, label int").distinct()
    found = found.orderBy(F.xxhash64("codes", "label"), "codes", "label").limit(MAX_FINDINGS).collect()
    rows = sorted((bytes(r["codes"]), r["label"]) for r in found)
    made = [(t, s, e, label) for t, a, b, label in generated() for s, e in places(a, b)] + buried()
    x = [np.array([window(t, a, b) for t, a, b, _ in made], np.int64)]
    y = [np.array([label for *_, label in made], float)]
    if rows:
        codes, hit = np.stack([np.frombuffer(c, np.uint8) for c, _ in rows]).astype(np.int64), np.array([label for _, label in rows]) == 1
        fresh = generated(4 * MAX_FINDINGS, 8)
        secrets, clean = ([t[a:b] for t, a, b, label in fresh if label == wanted] for wanted in (1, 0))
        x += [codes[hit], planted(codes, clean), planted(codes[~hit], secrets)]
        y += [np.ones(hit.sum()), np.zeros(len(codes)), np.ones((~hit).sum())]
    return CharCnn().fit(np.concatenate(x), np.concatenate(y))


def model_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in candidates(text) if not any(s < b and a < e for s, _, e in base)]


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(model):
    def run(batches):
        cnn = model.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            open_ = [(i, a, b) for i, t in enumerate(texts) for a, b in model_spans(t, base[i])]
            every = [list(x) for x in base]
            best = np.zeros(len(open_))
            seen = ((j, i, s, e) for j, (i, a, b) in enumerate(open_) for s, e in places(a, b))
            while part := list(islice(seen, 4096)):
                p = cnn.probability(np.array([window(texts[i], s, e) for _, i, s, e in part], np.int64))
                np.maximum.at(best, [j for j, *_ in part], p)
            for (i, a, b), q in zip(open_, best, strict=True):
                if q >= cnn.threshold:
                    every[i].append((a, 3, b))
            counts = [[sum(k == kind for _, k, _ in x) for x in base] for kind in range(3)]
            sha = [hashlib.sha256(_listed(x).encode()).hexdigest() for x in base]
            cols = [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array([_listed(sorted(x)) for x in every], pa.string())]
            yield pa.record_batch(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_scan(model), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


# --- the registered query -------------------------------------------------


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLES: dict[str, str] = {}
